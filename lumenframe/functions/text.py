"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that content tokens leave out
CONTENT_STOPWORDS = ("the", "and", "for", "with", "from", "that", "this")
# fixed values: words that answer keywords leave out
KEYWORD_STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "be", "by", "with", "at", "as", "it",
    "this", "that", "these", "those", "from", "into", "than", "then", "they", "their", "there", "here", "yes", "no",
)
# fixed values: greetings that need no video
GREETINGS = ("who are you", "what can you do", "你是谁", "你是什么", "你能做什么", "hello", "hi there", "hi!", "hey", "你好", "嗨", "在吗")
# fixed values: spoken terms and their written form
TERMS = ((r"(?i)\ba\s*(?:二|2|two)\s*c\b", "A2C"), (r"(?i)\brl\b", "RL"), (r"(?i)\breinforce\b", "REINFORCE"), (r"(?i)\btd\b", "TD"))
# fixed values: ranges of emoji
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize(c) -> Column:
    """Lower case; all but ASCII letters, digits and CJK becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def content_tokens(c) -> Column:
    """Normalized words of three letters or more that aren't stopwords; repeats stay."""
    return F.filter(F.split(normalize(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*CONTENT_STOPWORDS))


def contains_tokens(c, tokens: Column, most: int = 6) -> Column:
    """Whether the first ``most`` tokens all occur as substrings."""
    return (F.size(tokens) > 0) & F.forall(F.slice(tokens, 1, most), lambda t: F.contains(col(c), t))


def token_hits(c, tokens: Column) -> Column:
    """How many tokens, with multiplicity, occur as substrings."""
    return F.size(F.filter(tokens, lambda t: F.contains(col(c), t)))


def answer_keywords(c, limit: int = 5) -> Column:
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_']+"), 0)
    return F.slice(F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*KEYWORD_STOPWORDS))), 1, limit)


def contains_any(c, markers) -> Column:
    """Substring lexicon, case folded."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m.lower()))
    return out


def html_escape(c) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def vtt_time(c) -> Column:
    """``HH:MM:SS.mmm`` of non-negative seconds."""
    ms = F.bround(F.greatest(col(c), F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def postprocess(c) -> Column:
    """Recognized speech: emoji out, white space squeezed, known terms rewritten."""
    out = squeeze(F.regexp_replace(F.coalesce(col(c), F.lit("")), EMOJI, ""))
    for pattern, to in TERMS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def make_title(c) -> Column:
    """One line of at most 48 characters."""
    t = squeeze(c)
    return F.when(F.length(t) > 48, F.concat(F.rtrim(F.substring(t, 1, 47)), F.lit("..."))).otherwise(t)


def should_use_video(c) -> Column:
    t = F.lower(F.trim(col(c)))
    return (t != "") & ~(contains_any(t, GREETINGS) & (F.length(t) < 40))


def hotwords(c) -> Column:
    return F.filter(F.transform(F.split(col(c), "[,，\n]"), lambda x: F.trim(x)), lambda x: x != "")


def fts_terms(c, most: int = 12) -> Column:
    """The first ``most`` terms between blanks, without double quotes."""
    terms = F.transform(F.split(F.trim(col(c)), r"\s+"), lambda t: F.replace(t, F.lit('"'), F.lit("")))
    return F.filter(F.slice(terms, 1, most), lambda t: t != "")


def content_id(c) -> Column:
    return F.substring(F.sha2(col(c).cast("binary"), 256), 1, 16)


def cache_key(*cols) -> Column:
    return F.sha1(F.concat_ws("\0", *[col(c) for c in cols]))


def fingerprint(*cols) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1e", *[col(c) for c in cols])), 1, 12)


def shown(c) -> Column:
    """A metric for a report: a dash for null, three decimals otherwise."""
    return F.coalesce(F.format_string("%.3f", col(c).cast("double")), F.lit("-"))
