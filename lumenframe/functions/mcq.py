"""Multiple-choice questions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let
from .text import col, contains_any, contains_tokens, content_tokens, normalize, squeeze, token_hits

# fixed values: the phrases that end a block of candidates, after a blank line
BLOCK_ENDS = ("Answer the question", "Reference key frames", "请回答", "回答问题")
# fixed values: patterns of options, events and explicit answers, in Java's form
OPTION = r"(?ms)^\s*([A-E][).]\s+.+?)(?=^\s*[A-E][).]\s+|\z)"
EVENT = r"(?ms)^\s*(\([a-z]\)\s+.+?)(?=^\s*\([a-z]\)\s+|\n\s*Candidates:|\z)"
EXPLICIT = r"(?iU)\b(?:answer|correct answer|选项|答案)\s*[:：]?\s*\**([A-E])\**\s*[).]"
BARE = r"(?U)\b([A-E])\s*[).]\s+"
# fixed values: words of a sentence that refutes what it names
REFUTES = (
    "not", "does not", "doesn't", "contradict", "contradicted", "false", "invalid", "not true", "not supported", "does not explicitly", "无法支持", "不支持", "错误",
)
ITEM = "array<struct<label: string, text: string>>"


def _items(block: Column, pattern: str, head: str, at: int) -> Column:
    found = F.regexp_extract_all(block, F.lit(pattern), 1)
    made = F.transform(found, lambda i: F.struct(F.substring(F.trim(i), at, 1).alias("label"), squeeze(F.regexp_replace(i, head, "")).alias("text")))
    return F.filter(made, lambda x: x["text"] != "")


def options(c) -> Column:
    """``array<struct<label, text>>`` of the block after ``Candidates:``; options without text are left out."""
    block = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)Candidates:(.*)\z", 1)
    block = F.regexp_replace(block, r"(?s)\n\s*\n\s*(?:" + "|".join(BLOCK_ENDS) + r").*\z", "")
    return _items(block, OPTION, r"^\s*[A-E][).]", 1)


def events(c) -> Column:
    """``array<struct<label, text>>`` of the ``(a) ...`` items before ``Candidates:``."""
    block = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)Candidates:.*\z", "")
    return _items(block, EVENT, r"^\s*\([a-z]\)", 2)


def order_sequence(c) -> Column:
    """Labels of ``(x)(y)(z)``, lower-cased."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\(([A-Za-z])\)"), 1), lambda x: F.lower(x))


def selected_label(answer, opts) -> Column:
    """The chosen label: an explicit answer, else a bare ``X)``, else the first option whose text occurs."""
    a = F.coalesce(col(answer), F.lit(""))
    explicit, bare = F.upper(F.regexp_extract(a, EXPLICIT, 1)), F.regexp_extract(a, BARE, 1)
    labels = F.transform(col(opts), lambda o: F.upper(o["label"]))
    label = F.when(explicit != "", explicit).when(bare != "", bare)
    norm = normalize(a)
    by_text = F.try_element_at(F.filter(col(opts), lambda o: (normalize(o["text"]) != "") & F.contains(norm, normalize(o["text"]))), F.lit(1))["label"]
    return F.when(label.isNotNull(), F.when(F.array_contains(labels, label), label)).otherwise(by_text)


def option_of(label, opts) -> Column:
    """The option of that label, null if none."""
    return F.try_element_at(F.filter(col(opts), lambda o: o["label"] == label), F.lit(1))


def option_tokens(opts) -> Column:
    """``array<struct<label, tokens>>``: the content tokens of each option, repeats included."""
    return F.transform(col(opts), lambda o: F.struct(o["label"].alias("label"), content_tokens(o["text"]).alias("tokens")))


def token_scores(text, tokens) -> Column:
    """``option_scores`` of options that ``option_tokens`` has cut: many texts that meet the same options cut them once."""

    def row(o, n, hits):
        return F.struct(o["label"].alias("label"), hits.alias("hits"), (hits >= F.least(F.lit(2), F.greatest(F.lit(1), n))).alias("supported"))

    one = lambda low, o: let(token_hits(low, o["tokens"]), lambda hits: row(o, F.size(o["tokens"]), hits))
    # tokens have no character that ``normalize`` takes out, so they occur in the folded text just where they do in the normalized one
    return let(F.lower(F.coalesce(col(text), F.lit(""))), lambda low: F.transform(col(tokens), lambda o: one(low, o)))


def option_scores(text, opts) -> Column:
    """``array<struct<label, hits, supported>>``: content tokens of each option, repeats included, found in the text."""
    return token_scores(text, option_tokens(opts))


def temporal_option(opts, order) -> Column:
    """The first option whose ``(x)(y)`` sequence equals the order of labels; null if the order is null or empty."""
    same = F.filter(col(opts), lambda o: (F.size(order_sequence(o["text"])) > 0) & (order_sequence(o["text"]) == col(order)))
    return F.when(F.size(col(order)) > 0, F.try_element_at(same, F.lit(1)))


def option_contradiction(answer, opts, label) -> Column:
    """``struct<reason, sentence>`` where the answer names several labels or refutes the selected option, else null."""
    a = F.coalesce(col(answer), F.lit(""))
    labels = F.transform(col(opts), lambda o: F.upper(o["label"]))
    named = F.transform(F.regexp_extract_all(a, F.lit(r"(?iU)\b([A-E])\s*[).]"), 1), lambda x: F.upper(x))
    several = F.size(F.array_distinct(F.filter(named, lambda x: F.array_contains(labels, x)))) > 1
    tokens = F.array_distinct(content_tokens(option_of(col(label), opts)["text"]))

    def refuted(s):
        hits = F.size(F.filter(tokens, lambda t: F.contains(normalize(s), t)))
        names = F.size(F.regexp_extract_all(s, F.concat(F.lit(r"(?iU)\b"), col(label), F.lit(r"\b")), 0)) > 0
        return contains_any(s, REFUTES) & (names | (hits >= F.least(F.lit(2), F.size(tokens))))

    sentence = F.try_element_at(F.filter(F.split(a, "[\n。！？.!?]+"), refuted), F.lit(1))
    made = F.when(several, F.struct(F.lit("multiple_candidate_labels").alias("reason"), F.lit(None).cast("string").alias("sentence"))).when(
        sentence.isNotNull(), F.struct(F.lit("selected_option_refuted").alias("reason"), F.trim(sentence).alias("sentence"))
    )
    return F.when(col(label).isNotNull(), made)


def supports_option(answer, text) -> Column:
    """Whether the answer holds the option's first six tokens, or two of its tokens (one, if it has one)."""
    tokens, low = content_tokens(text), F.lower(F.coalesce(col(answer), F.lit("")))
    return contains_tokens(normalize(answer), tokens) | ((F.size(tokens) > 0) & (token_hits(low, tokens) >= F.least(F.lit(2), F.size(tokens))))


def recommended_option(reference, opts) -> Column:
    """The option that a reference answer names: by order, by equal text, or as part of its text; the first of them."""
    ref = F.coalesce(col(reference), F.lit(""))
    bare = lambda c: F.rtrim(F.lower(F.trim(c)), F.lit("."))
    order = order_sequence(ref)
    fits = lambda o: ((F.size(order) > 0) & (order_sequence(o["text"]) == order)) | F.contains(bare(o["text"]), bare(ref))
    return F.when(ref != "", F.try_element_at(F.filter(col(opts), fits), F.lit(1)))


def format_question(question, candidates) -> Column:
    """The question with lettered options; empty options keep their letter but no line."""
    lines = F.transform(col(candidates), lambda c, i: F.when(c != "", F.concat(F.substr(F.lit("ABCDE"), i + 1, F.lit(1)), F.lit(") "), c)))
    tail = F.lit("\n\nAnswer the question and reference key frames with [FRAME:t=...] markers.")
    return F.concat(F.trim(col(question)), F.lit("\n\nCandidates:\n"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), tail)
