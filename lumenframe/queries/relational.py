"""Catalogue tables: sessions, videos, users, caches and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import KEYWORD_STOPWORDS
from ..operators import merge
from .registry import query, read


@query("sessions_left_videos", "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def sessions(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", "quality")


@query("missing_predictions", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left_anti")


@query("upsert_videos", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS updated, min(event_id) AS created FROM events GROUP BY user_id, event_type")
def upsert(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("updated"), F.col("event_id").alias("created"))
    half = F.col("updated") % 2 == 0
    return merge.upsert(e.where(half), e.where(~half), ["user_id", "event_type"], "updated", "created")


@query("insert_if_absent", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def insert_absent(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return merge.insert_if_absent(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0"), "c_custkey")


@query("cache_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def cache_latest(spark, sf):
    return merge.latest(read(spark, sf, "events"), "user_id", "event_id", "event_type", "value")


@query("shard_scan", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i % 4 = 1")
def shard_scan(spark, sf):
    return merge.shard(read(spark, sf, "part").select("p_partkey"), "p_partkey", 1, 4)


@query("recent_sessions", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 50")
def recent_sessions(spark, sf):
    o = read(spark, sf, "orders")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_custkey", "o_orderkey")


@query("dataset_convert", f"""WITH b AS (SELECT *, 'v' || item_id % 7 AS v FROM benchmark WHERE text <> '' AND item_id % 5 > 0),
w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda x: length(x) >= 3 AND x NOT IN ({", ".join(f"'{x}'" for x in KEYWORD_STOPWORDS)})) AS w FROM b)
SELECT 'interval-' || v || '-' || item_id AS case_id, trim(text) || chr(10) || chr(10) || 'Candidates:' || chr(10) || 'A) ' || text || chr(10) || 'C) no' || chr(10) || chr(10) || 'Answer the question and reference key frames with [FRAME:t=...] markers.' AS question, text AS reference_answer,
 list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5) AS required_keywords, CASE WHEN item_id % 2 = 0 THEN item_id + 1.0 END::DOUBLE AS gold, CASE WHEN item_id % 3 = 0 THEN 'build_timeline' END AS expected_action FROM b JOIN w USING (item_id)""")
def convert(spark, sf):
    from ..datasets import interval_cases

    i = F.col("item_id")
    b = read(spark, sf, "benchmark").withColumns({"video_id": F.concat(F.lit("v"), (i % 7).cast("string")), "qid": i.cast("string")})
    rows = b.select("video_id", "qid", F.when(i % 3 == 0, "TN").otherwise("CH").alias("type"), F.col("text").alias("question"), F.when(i % 5 > 0, F.col("text")).alias("answer"), F.col("text").alias("a0"), F.lit("").alias("a1"), F.lit("no").alias("a2"), F.lit(None).cast("string").alias("a3"), F.lit("").alias("a4"))
    x = i.cast("double")
    spans = b.where("item_id % 2 = 0").select("video_id", "qid", F.array(F.array(x + 2, x), F.array(x)).alias("spans"))
    made = interval_cases(rows, spans)
    return made.select("case_id", "question", "reference_answer", "required_keywords", F.try_element_at("gold_timestamps", F.lit(1)).alias("gold"), "expected_action")


@query("captions_stub", "SELECT doc_id, 'caption ' || left(sha1(text), 8) AS caption FROM documents")
def captions(spark, sf):
    from ..udf import map_text

    return map_text(read(spark, sf, "documents").select("doc_id", "text"), "text", "caption").select("doc_id", "caption")


@query("encoder_stub", r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations), h AS (SELECT conv_id, turn, ('0x' || left(md5(w), 8))::BIGINT AS h FROM w),
b AS (SELECT conv_id, turn, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS n FROM b GROUP BY ALL)
SELECT conv_id, turn, i::INT AS i, round(v / n, 6) AS v FROM b JOIN n USING (conv_id, turn) WHERE v <> 0""")
def encoder(spark, sf):
    from ..udf import encode_text

    made = encode_text(read(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", "vector")
    return made.select("conv_id", "turn", F.posexplode("vector").alias("i", "v")).where("v <> 0").select("conv_id", "turn", "i", F.round("v", 6).alias("v"))
