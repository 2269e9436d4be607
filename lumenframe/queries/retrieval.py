"""Search and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import even_indices
from ..operators import search
from ..operators.textindex import TextIndex
from ..operators.vectorindex import VectorIndex
from ..plans import tools
from ..runtime import scratch
from .registry import query, read, read_even

TERMS = ["the", "ertion", "onble"]
QUERY = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
COSINE = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"


def _bm25_sql(limit: str) -> str:
    fs = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(TERMS))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(TERMS)))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(TERMS)))
    return f"""t AS (SELECT doc_id, lang, regexp_extract_all(translate(lower(text), '{search.ACCENTED}', '{search.PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS tk FROM documents),
r AS (SELECT doc_id, lang, len(tk) AS dl, {fs} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {ns} FROM r),
b AS (SELECT doc_id, lang, {score} AS bm25 FROM r, s WHERE {hit} ORDER BY bm25 DESC, doc_id {limit})"""


@query("keyword_search", "SELECT doc_id, lang, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'ention') ORDER BY doc_id LIMIT 20")
def keyword_search(spark, sf):
    return search.keyword_search(read(spark, sf, "documents"), " Ention ", 20).select("doc_id", "lang", "score")


@query("keyword_like_fallback", "SELECT doc_id, 0.0::DOUBLE AS rank FROM documents WHERE text ILIKE '%the thion%' OR contains(lower(text), 'there') ORDER BY doc_id LIMIT 20")
def keyword_like(spark, sf):
    return search.like_fallback(read(spark, sf, "documents"), "There", 20).select("doc_id", "rank")


@query("bm25_topk", f"WITH {_bm25_sql('LIMIT 20')} SELECT doc_id, round(bm25, 6) AS score FROM b")
def bm25_topk(spark, sf):
    found = search.bm25(read_even(spark, sf, "documents"), TERMS)
    return search.top(found, "bm25", 20, "doc_id").select("doc_id", F.round("bm25", 6).alias("score"))


@query("fts_inverse_score", f"WITH {_bm25_sql('LIMIT 20')} SELECT doc_id, round(1 / (1 + abs(-bm25)), 6) AS inverse_score FROM b")
def fts_inverse(spark, sf):
    found = search.top(search.bm25(read_even(spark, sf, "documents"), TERMS), "bm25", 20, "doc_id")
    return found.select("doc_id", F.round(1 / (1 + F.abs(-F.col("bm25"))), 6).alias("inverse_score"))


@query("dense_topk", f"SELECT vec_id, label, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 20")
def dense_topk(spark, sf):
    found = search.dense(read(spark, sf, "embeddings"), QUERY)
    return search.top(found, "score", 20, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "hybrid_rrf",
    f"""WITH {_bm25_sql("LIMIT 10")},
sp AS (SELECT doc_id, bm25 AS score, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM b),
dn AS (SELECT doc_id, {COSINE} AS score, row_number() OVER (ORDER BY {COSINE} DESC, doc_id) AS rank FROM documents JOIN embeddings ON doc_id = vec_id QUALIFY rank <= 10),
u AS (SELECT doc_id, rank, rank AS seen FROM sp UNION ALL SELECT doc_id, rank, 1000000 + rank FROM dn),
g AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS rrf, min(seen) AS seen FROM u GROUP BY doc_id)
SELECT doc_id, round(rrf, 9) AS rrf, '[TRANSCRIPT:t=' || printf('%.1f', doc_id * 3.0) || '-' || printf('%.1f', doc_id * 3.0 + 4.0) || ']' AS marker FROM g ORDER BY g.rrf DESC, seen LIMIT 5""",
)
def hybrid_rrf(spark, sf):
    from ..functions.markers import marker

    docs = read_even(spark, sf, "documents")
    span = lambda d: d.select("doc_id", "score", "rank", F.bround(F.col("doc_id") * 3.0, 2).alias("t_start"), F.bround(F.col("doc_id") * 3.0 + 4.0, 2).alias("t_end"))
    sparse = search.ranked(search.bm25(docs, TERMS).withColumnRenamed("bm25", "score"), "score", 10, "doc_id")
    vectors = read(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id").join(read(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    near = search.ranked(search.dense(vectors, QUERY).select("doc_id", "score"), "score", 10, "doc_id")
    fused = search.rrf([span(sparse), span(near)], ["t_start", "t_end"], "doc_id", 5)
    return fused.select("doc_id", F.round("rrf", 9).alias("rrf"), marker(F.lit("transcript"), "t_start", "t_end").alias("marker"))


@query(
    "two_stage_retrieve",
    f"""WITH f AS (SELECT vec_id::DOUBLE AS ts, {COSINE} AS score FROM embeddings),
sc AS (SELECT vec_id::DOUBLE AS s, vec_id + 9.0 AS e, {COSINE} AS score FROM embeddings ORDER BY score DESC, s LIMIT 5),
ga AS (SELECT ts, score, 0 AS tier, row_number() OVER (ORDER BY score DESC, ts) AS rank FROM f WHERE EXISTS (SELECT 1 FROM sc WHERE ts BETWEEN s AND e) QUALIFY rank <= 8),
gl AS (SELECT ts, score, 1 AS tier, row_number() OVER (ORDER BY score DESC, ts) AS rank FROM f QUALIFY rank <= 36),
o AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY tier, rank) AS r FROM (SELECT * FROM ga UNION ALL SELECT * FROM gl))
SELECT ts, round(score, 6) AS score, tier FROM o WHERE r = 1 ORDER BY tier, rank LIMIT 12""",
)
def two_stage(spark, sf):
    e = read(spark, sf, "embeddings")
    frames = e.select(F.col("vec_id").cast("double").alias("ts"), "embedding")
    scenes = e.select(F.col("vec_id").cast("double").alias("start"), (F.col("vec_id") + 9.0).alias("end"), "embedding")
    return search.two_stage(scenes, frames, QUERY, 5, 12).select("ts", F.round("score", 6).alias("score"), "tier")


@query(
    "evenly_spaced_frames",
    """WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
i AS (SELECT label, n, unnest(range(0, 12)) AS j FROM g)
SELECT DISTINCT label, least(n - 1, CASE WHEN n <= 12 THEN least(j, n - 1) ELSE round_even(j * ((n - 1) / 11.0), 0)::BIGINT END) AS idx FROM i""",
)
def evenly_spaced(spark, sf):
    g = read(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", F.explode(even_indices("n", 12)).alias("idx"))


@query("scene_quota", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN greatest(1, (event_id % 40) * 2 // 3) ELSE event_id % 40 END::INT AS quota FROM events")
def scene_quota(spark, sf):
    """How many of an event's frames come from scenes, where it has any."""
    k = (F.col("event_id") % 40).cast("int")
    return read(spark, sf, "events").select("event_id", search.scene_share(k, F.col("event_id") % 2 == 0).cast("int").alias("quota"))


_WORDS = f"regexp_extract_all(translate(lower(text), '{search.ACCENTED}', '{search.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
#: Documents of every source but one, which was written again with every third of its documents.
_LIVE = "SELECT doc_id, source, text FROM documents WHERE source IS NOT NULL AND (source <> 'src3' OR doc_id % 3 = 0)"


def document_index(spark, sf):
    """All documents, an owner a source; one source is then replaced by a third of its documents."""
    docs = read_even(spark, sf, "documents").where("source is not null").select(F.col("source").alias("video"), F.lit("transcript").alias("kind"), F.col("doc_id").alias("doc"), "text")
    index = TextIndex(spark, scratch(spark, "text-index"))
    index.write(docs)
    index.write(docs.where("video = 'src3' and doc % 3 = 0"))
    return index


@query(
    "text_index_bm25",
    f"""WITH t AS (SELECT doc_id, {_WORDS} AS tk FROM ({_LIVE})),
r AS (SELECT doc_id, len(tk) AS dl, len(list_filter(tk, lambda x: x = 'the')) AS f0, len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'of' AND tk[i + 1] = 'the')) AS f1, len(list_filter(tk, lambda x: x = 'une')) AS f2 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM r),
b AS (SELECT doc_id, {" + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3))} AS bm25 FROM r, s WHERE f0 > 0 OR f1 > 0 OR f2 > 0)
SELECT doc_id, round(bm25, 6) AS score FROM b ORDER BY bm25 DESC, doc_id LIMIT 50""",
)
def text_index_bm25(spark, sf):
    return document_index(spark, sf).search("The of-the une", 50).select(F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("score"))


_QUESTIONS = """q AS (SELECT conv_id, 'src' || conv_id % 20 AS source, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


@query(
    "batched_text_retrieval",
    f"""WITH {_QUESTIONS},
p AS (SELECT conv_id, source, unnest(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(translate(lower(question), '{search.ACCENTED}', '{search.PLAIN}'), '\\s+'), lambda x: x <> '')[1:12],
  lambda x: regexp_extract_all(replace(x, '"', ''), '[\\p{{L}}\\p{{N}}]+')), lambda w: len(w) > 0))) AS ph FROM q),
t AS (SELECT doc_id, source, {_WORDS} AS tk FROM ({_LIVE})), st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM t),
w AS (SELECT doc_id, source, len(tk) AS dl, tk, unnest(tk) AS w, unnest(range(1, len(tk) + 1)) AS i FROM t),
f AS (SELECT ph, doc_id, source, dl, count(*) AS f FROM (SELECT DISTINCT ph FROM p) JOIN w ON w.w = ph[1] AND tk[i:i + len(ph) - 1] = ph GROUP BY ALL),
c AS (SELECT ph, count(*) AS nt FROM f GROUP BY ph),
s AS (SELECT conv_id, doc_id, sum(greatest(ln((n - nt + 0.5) / (nt + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM p JOIN c USING (ph) JOIN f USING (ph, source), st GROUP BY conv_id, doc_id)
SELECT conv_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY bm25 DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 5""",
)
def batched_text_retrieval(spark, sf):
    found = document_index(spark, sf).search_many(questions(spark, sf), 5, "conv_id")
    return found.select("conv_id", F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("score"), "rank")


def questions(spark, sf):
    """Every conversation's last question, about the video of one source."""
    c = read(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return c.withColumn("video", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")))


@query(
    "vector_index_exact",
    """SELECT q.vec_id AS question, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 QUALIFY rank <= 10""",
)
def vector_index_exact(spark, sf):
    e = read(spark, sf, "embeddings")
    index = VectorIndex.build(e, scratch(spark, "vector-index"), 16, "vec_id")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("query"))
    return index.search_many(asked, 10, "question", "vec_id", probes=None).select("question", "vec_id", "rank")


_FRAMES = "SELECT label, vec_id::DOUBLE AS ts, vec_id::DOUBLE AS s, vec_id + 9.0 AS e, embedding::DOUBLE[] AS v FROM embeddings"


@query(
    "session_search",
    f"""WITH {_QUESTIONS}, fr AS ({_FRAMES}), qv AS (SELECT conv_id, conv_id % 10 AS label, embedding::DOUBLE[] AS qv FROM q JOIN embeddings ON vec_id = conv_id),
sc AS (SELECT conv_id, s, e, row_number() OVER (PARTITION BY conv_id ORDER BY list_cosine_similarity(v, qv) DESC, s, e) AS rank FROM qv JOIN fr USING (label) QUALIFY rank <= 5),
f AS (SELECT conv_id, ts, list_cosine_similarity(v, qv) AS score FROM qv JOIN fr USING (label)),
ga AS (SELECT conv_id, ts, score, 0 AS tier, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, ts) AS rank FROM f WHERE EXISTS (SELECT 1 FROM sc WHERE sc.conv_id = f.conv_id AND ts BETWEEN s AND e) QUALIFY rank <= 8),
gl AS (SELECT conv_id, ts, score, 1 AS tier, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, ts) AS rank FROM f QUALIFY rank <= 36),
o AS (SELECT * FROM (SELECT * FROM ga UNION ALL SELECT * FROM gl) QUALIFY row_number() OVER (PARTITION BY conv_id, ts ORDER BY tier, rank) = 1),
t AS (SELECT conv_id, ts FROM o QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY tier, rank) <= 12)
SELECT conv_id, list(ts ORDER BY ts) AS frames, (SELECT list(s ORDER BY s) FROM sc WHERE sc.conv_id = t.conv_id) AS scenes FROM t GROUP BY conv_id""",
)
def session_search(spark, sf):
    """The tool's own two-stage search for every conversation that has a vector, in the frames of one label."""
    e = read(spark, sf, "embeddings").withColumn("video", F.col("label"))
    frames = e.select("video", F.col("vec_id").cast("double").alias("ts"), "embedding")
    scenes = e.select("video", F.col("vec_id").cast("double").alias("start"), (F.col("vec_id") + 9.0).alias("end"), "embedding")
    asked = questions(spark, sf).join(e.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("query")), "conv_id").withColumn("video", (F.col("conv_id") % 10).cast("int"))
    got = tools.search_video(tools.state(asked), "conv_id", scenes, frames)
    return got.where(F.size("frames") > 0).select("conv_id", F.transform("frames", lambda f: f["timestamp"]).alias("frames"), F.transform("scenes", lambda s: s["start"]).alias("scenes"))
