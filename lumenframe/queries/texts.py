"""Text, marker and multiple-choice queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markers, mcq, text
from ..operators import matrix
from ..runtime import stored
from ..sources.files import vtt_cues
from .registry import query, read, read_even

NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"
_CONTENT = ", ".join(f"'{w}'" for w in text.CONTENT_STOPWORDS)
TOKENS = f"list_filter(string_split({NORMAL}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({_CONTENT}))"
ANSWER = "('Saw it [SLIDE:t=' || turn || '.5] and ' || text || ' [TRANSCRIPT:t=' || (turn + 9) || '-' || (turn + 3) || '.25] then [FRAME:t=' || (conv_id % 60) || '.0].')"


def answers(spark, sf):
    c = read(spark, sf, "conversations")
    s = lambda x: x.cast("string")
    return c.withColumn("answer", F.concat(
        F.lit("Saw it [SLIDE:t="), s(F.col("turn")), F.lit(".5] and "), F.col("text"), F.lit(" [TRANSCRIPT:t="), s(F.col("turn") + 9), F.lit("-"), s(F.col("turn") + 3),
        F.lit(".25] then [FRAME:t="), s(F.col("conv_id") % 60), F.lit(".0]."),
    ))


@query("content_tokens", f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS tk FROM documents) SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens FROM t")
def content_tokens(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", text.content_tokens("text").alias("tk"))
    return t.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in text.KEYWORD_STOPWORDS)


@query("answer_keywords", f"""WITH k AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS w FROM conversations)
SELECT conv_id, turn, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5) AS keywords FROM k""")
def answer_keywords(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.answer_keywords("text").alias("keywords"))


_M = r"\[(?:FRAME:t=[0-9]+(?:\.[0-9]+)?|SLIDE:t=[0-9]+(?:\.[0-9]+)?|TRANSCRIPT:t=[0-9]+(?:\.[0-9]+)?-[0-9]+(?:\.[0-9]+)?)\]"


@query("markers_extract", f"""WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all({ANSWER}, '{_M}')) AS raw, generate_subscripts(regexp_extract_all({ANSWER}, '{_M}'), 1) AS i FROM conversations),
p AS (SELECT *, lower(regexp_extract(raw, '\\[([A-Z]+):', 1)) AS kind, regexp_extract(raw, 't=([0-9.]+)', 1)::DOUBLE AS a, TRY_CAST(regexp_extract(raw, '-([0-9.]+)\\]', 1) AS DOUBLE) AS b FROM m)
SELECT conv_id, turn, (i - 1)::INT AS pos, raw, kind, least(a, coalesce(b, a)) AS t_start, greatest(a, coalesce(b, a)) AS t_end FROM p""")
def markers_extract(spark, sf):
    m = answers(spark, sf).select("conv_id", "turn", F.posexplode(markers.extract("answer")).alias("pos", "m"))
    return m.select("conv_id", "turn", "pos", "m.raw", "m.kind", "m.t_start", "m.t_end")


@query("mcq_parse", f"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, item_id % 4 AS k FROM benchmark),
p AS (SELECT item_id, CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN CASE WHEN {NORMAL.format('a')} <> '' THEN 'A' ELSE 'B' END END AS selected, a FROM b)
SELECT item_id, 'A' AS label, a AS option_text, selected FROM p WHERE a <> '' UNION ALL SELECT item_id, 'B', 'none of ' || a, selected FROM p""")
def mcq_parse(spark, sf):
    """Options of whole item texts; the answer names one explicitly, by a bare letter, by its text, or not at all."""
    b = read(spark, sf, "benchmark").select("item_id", text.squeeze("text").alias("a"))
    q = F.concat(F.lit("Which one?\n\nCandidates:\nA) "), "a", F.lit("\nB) none of "), "a", F.lit("\n \nReference key frames please"))
    k = F.col("item_id") % 4
    said = F.when(k == 0, "the ANSWER: **b** ) so").when(k == 1, "so A) it is").when(k == 2, F.concat(F.lit("it was none of "), "a")).otherwise("neither")
    rows = b.select("item_id", mcq.options(q).alias("opts"), said.alias("said"))
    picked = mcq.selected_label("said", "opts")
    return rows.select("item_id", picked.alias("selected"), F.explode("opts").alias("o")).select("item_id", "o.label", F.col("o.text").alias("option_text"), "selected")


@query("mcq_option_scores", f"""WITH n AS (SELECT count(*) AS n FROM benchmark), o AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, item_id, {TOKENS.format("text")} AS tk FROM benchmark),
d AS (SELECT doc_id, doc_id % n AS i, {NORMAL.format("text")} AS n FROM documents, n)
SELECT doc_id, item_id, len(list_filter(tk, lambda x: contains(n, x))) AS hits, len(list_filter(tk, lambda x: contains(n, x))) >= least(2, greatest(1, len(tk))) AS supported FROM d JOIN o USING (i)""")
def mcq_scores(spark, sf):
    """Every document against the option that its id points to."""
    items = read(spark, sf, "benchmark")
    numbered = items.withColumn("i", F.row_number().over(W.orderBy("item_id")) - 1)  # the questions of one set are few
    n = items.agg(F.count(F.lit(1)).alias("n"))
    d = read_even(spark, sf, "documents").select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("i", F.col("doc_id") % F.col("n"))
    opts = F.array(F.struct(F.lit("A").alias("label"), F.col("text")))
    o = stored(numbered.select("i", "item_id", mcq.option_tokens(opts).alias("tokens")), "options")  # cut once, not for every text
    scored = d.join(F.broadcast(o), "i").select("doc_id", "item_id", mcq.token_scores("text", "tokens")[0].alias("s"))
    return scored.select("doc_id", "item_id", F.col("s.hits").cast("long").alias("hits"), "s.supported")


_CAND = f"c AS (SELECT item_id, {TOKENS.format('text')} AS tk FROM benchmark)"


@query("candidate_timeline", f"""WITH {_CAND}, e AS (SELECT doc_id, lower(text) AS low FROM documents), p AS (SELECT item_id, doc_id, len(list_filter(tk, lambda x: contains(low, x))) AS hits, len(tk) AS n FROM c, e),
b AS (SELECT item_id, doc_id, hits FROM p WHERE hits >= CASE WHEN n <= 2 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) = 1)
SELECT c.item_id::VARCHAR AS label, CASE WHEN b.item_id IS NULL THEN 'missing' ELSE 'found' END AS status, b.doc_id::DOUBLE AS t, coalesce(hits, 0)::BIGINT AS hits FROM c LEFT JOIN b USING (item_id)""")
def candidate_timeline(spark, sf):
    c = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("label"), "text")
    e = read_even(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("double").alias("t"), "text")
    return matrix.candidate_timeline(c, e).select("label", "status", "t", F.col("hits").cast("long").alias("hits"))


_SIX = "list_slice({}, 1, 6)"
_HOLDS = "len(list_filter({}, lambda x: contains(low, x)))"


@query("av_matrix", f"""WITH c AS (SELECT item_id, tk, list_filter(tk, lambda x, i: list_position(tk, x) = i) AS u FROM (SELECT item_id, {TOKENS.format('text')} AS tk FROM benchmark)),
e AS (SELECT doc_id, lang, lower(text) AS low FROM documents WHERE lang IN ('de', 'es')),
x AS (SELECT item_id, doc_id, lang, len(tk) > 0 AND {_HOLDS.format(_SIX.format('tk'))} = len({_SIX.format('tk')}) AS full_, CASE WHEN len(u) > 0 AND {_HOLDS.format('u')} >= least(2, len(u)) THEN {_HOLDS.format('u')} END AS n, list_filter({_SIX.format('tk')}, lambda x: contains(low, x)) AS here, {_SIX.format('tk')} AS six FROM c, e),
f AS (SELECT item_id, lang, min(doc_id) FILTER (full_) AS first_full, arg_max(doc_id, n * 1000000000 - doc_id) FILTER (n IS NOT NULL) AS best, any_value(six) AS six, list_distinct(flatten(list(here))) AS found FROM x GROUP BY ALL),
s AS (SELECT item_id, lang, coalesce(first_full, best) AS ord, first_full IS NOT NULL OR best IS NOT NULL OR (len(six) > 0 AND len(list_filter(six, lambda t: NOT list_contains(found, t))) = 0) AS seen FROM f),
m AS (SELECT c.item_id, coalesce(v.seen, false) AS visual, coalesce(a.seen, false) AS audio, v.ord AS slide, a.ord AS transcript FROM c LEFT JOIN s v ON v.item_id = c.item_id AND v.lang = 'de' LEFT JOIN s a ON a.item_id = c.item_id AND a.lang = 'es')
SELECT item_id::VARCHAR AS label, visual, audio, slide, transcript, CASE WHEN visual AND NOT audio THEN 'match' ELSE 'reject' END AS not_heard, CASE WHEN audio AND NOT visual THEN 'match' ELSE 'reject' END AS not_seen, CASE WHEN audio AND visual THEN 'match' ELSE 'unknown' END AS both_ FROM m""")
def av_matrix(spark, sf):
    c = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("label"), "text")
    d = read_even(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text", "lang")
    m = matrix.av_matrix(c, d.where("lang = 'de'"), d.where("lang = 'es'"), "visible_not_mentioned").withColumnRenamed("decision", "not_heard")
    v, a = F.col("visual"), F.col("audio")
    return m.select("label", "visual", "audio", "slide", "transcript", "not_heard", F.when(a & ~v, "match").otherwise("reject").alias("not_seen"), F.when(a & v, "match").otherwise("unknown").alias("both_"))


_VTT = "printf('%02d:%02d:%02d.%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("vtt_cues", f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS cue, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || chr(10) || {_VTT.format("(turn * 3723500)::BIGINT")} || ' --> ' || {_VTT.format("(turn * 3723500 + 1250)::BIGINT")} || chr(10) || {_ESC.format("text")} AS block FROM conversations""")
def vtt(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 3723.5).alias("t_start"), (F.col("turn") * 3723.5 + 1.25).alias("t_end"))
    return vtt_cues(c, "conv_id", "turn").withColumnRenamed("key", "conv_id")


@query("content_ids", "SELECT doc_id, left(sha256(text), 16) AS content_id, sha1(lang || chr(0) || source) AS cache_key, left(sha1(lang || chr(30) || source), 12) AS fingerprint FROM documents")
def content_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.content_id("text").alias("content_id"), text.cache_key("lang", "source").alias("cache_key"), text.fingerprint("lang", "source").alias("fingerprint"))


@query("postprocess_text", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace('td  a two c 😀 rl ' || text || ' reinforce', '[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}]+', '', 'g')) AS x FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '\ba\s*(?:二|2|two)\s*c\b', 'A2C', 'gi'), '\brl\b', 'RL', 'gi'), '\breinforce\b', 'REINFORCE', 'gi'), '\btd\b', 'TD', 'gi')) AS text FROM t""")
def postprocess(spark, sf):
    x = F.concat(F.lit("td  a two c 😀 rl "), "text", F.lit(" reinforce"))
    return read(spark, sf, "conversations").select("conv_id", "turn", text.postprocess(x).alias("text"))


@query("html_escape", f"SELECT page_id, md5({_ESC.format('html')}) AS escaped FROM pages")
def html_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(text.html_escape("html")).alias("escaped"))


@query("message_titles", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN length(x) > 48 THEN rtrim(substr(x, 1, 47)) || '...' ELSE x END AS title, x <> '' AND NOT (regexp_matches(lower(x), 'hello|hey|hi there|hi!') AND length(x) < 40) AS use_video FROM t""")
def titles(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.make_title("text").alias("title"), text.should_use_video("text").alias("use_video"))


@query("duration_bucket", "SELECT doc_id, CASE WHEN n_chars <= 60 THEN 'short' WHEN n_chars <= 600 THEN 'medium' ELSE 'long' END AS bucket FROM documents")
def duration_bucket(spark, sf):
    d = F.col("n_chars")
    return read(spark, sf, "documents").select("doc_id", F.when(d <= 60, "short").when(d <= 600, "medium").otherwise("long").alias("bucket"))


@query("fts_terms", "SELECT doc_id, list_filter(list_transform(list_slice(regexp_split_to_array(trim(text), '\\s+'), 1, 12), lambda x: replace(x, '\"', '')), lambda x: x <> '') AS terms FROM documents")
def fts_terms(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.fts_terms("text").alias("terms"))
