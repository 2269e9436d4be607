"""The agent's loop, and ingest and control runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.sampling import allocate, allocated_sample
from ..plans import agent
from ..runtime import scratch
from ..sources import files
from .registry import query, read
from .temporal import T_SQL, seconds

_R, _A, _W, _V = "retrieve_transcript_evidence", agent.ASSESS, agent.ANSWER, agent.VERIFY


@query(
    "agent_loop",
    f"""WITH RECURSIVE c AS (SELECT conv_id, count(*) FILTER (role = 'user') + conv_id % 3 AS need FROM conversations GROUP BY conv_id),
s(conv_id, need, calls, last, fails, forced, found, drafts, sufficient, grounded, steps, step) AS (
 SELECT conv_id, need, 0, '', 0, false, 0, 0, false, false, '', '{_R}' FROM c
 UNION ALL SELECT * EXCLUDE (go), CASE WHEN calls >= 8 THEN CASE WHEN found > 0 AND drafts = 0 AND NOT forced THEN '{_W}' END WHEN fails >= 2 AND drafts > 0 THEN NULL WHEN last = '{_V}' AND grounded AND drafts > 0 THEN NULL
   WHEN last = '{_W}' THEN '{_V}' WHEN last = '{_V}' AND conv_id % 2 = 0 THEN '{_W}' WHEN last = '{_A}' AND sufficient THEN '{_W}' WHEN last = '{_R}' THEN '{_A}' ELSE '{_R}' END
 FROM (SELECT conv_id, need, calls + 1 AS calls, step AS last, CASE WHEN step = '{_V}' THEN CASE WHEN (drafts + conv_id) % 4 = 0 THEN 0 ELSE fails + 1 END ELSE fails END AS fails, forced OR calls >= 8 AS forced,
   found + CASE WHEN step = '{_R}' THEN 1 + conv_id % 2 ELSE 0 END AS found, drafts + CASE WHEN step = '{_W}' THEN 1 ELSE 0 END AS drafts, CASE WHEN step = '{_A}' THEN found >= need ELSE sufficient END AS sufficient,
   CASE WHEN step = '{_V}' THEN (drafts + conv_id) % 4 = 0 ELSE grounded END AS grounded, steps || CASE WHEN steps = '' THEN '' ELSE ',' END || step AS steps, step AS go FROM s WHERE step IS NOT NULL))
SELECT conv_id, calls::INT AS calls, steps, CASE WHEN calls >= 8 THEN CASE WHEN drafts > 0 THEN 'draft' ELSE 'cap' END WHEN fails >= 2 THEN 'draft' ELSE 'grounded' END AS ended, CASE WHEN drafts > 0 THEN 'draft ' || drafts END AS answer FROM s WHERE step IS NULL""",
)
def agent_loop(spark, sf):
    """Every conversation as a session that needs as much evidence as it has questions; tools stand for searches and model calls."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role") == "user") + F.col("conv_id") % 3).alias("need"))
    rows = c.withColumn("found", F.lit(0).cast("long")).withColumn("drafts", F.lit(0).cast("long"))
    grounded = (F.col("drafts") + F.col("conv_id")) % 4 == 0
    tools = {
        _R: lambda r: r.withColumn("found", F.col("found") + 1 + F.col("conv_id") % 2),
        _A: lambda r: r.withColumn("sufficient", F.col("found") >= F.col("need")).withColumn("recommended_next_action", F.lit(_R)),
        _W: lambda r: r.withColumn("drafts", F.col("drafts") + 1).withColumn("answer", F.concat(F.lit("draft "), F.col("drafts"))),
        _V: lambda r: r.withColumn("grounded", grounded).withColumn("next_action", F.when(F.col("conv_id") % 2 == 0, _W).otherwise(_R)),
    }
    done = agent.run(rows, agent.rule_planner, tools, F.col("found") > 0)
    return done.select("conv_id", "calls", F.array_join("steps", ",").alias("steps"), "ended", "answer")


@query(
    "nearest_hot_video",
    f"""WITH e AS (SELECT event_id, {T_SQL} AS t FROM events), g AS (SELECT event_id, t FROM e WHERE event_id % 10 = 0), f AS (SELECT DISTINCT t FROM e WHERE event_id % 10 <> 0),
n AS (SELECT g.event_id, g.t, b.t AS p, a.t AS n FROM g ASOF LEFT JOIN f b ON g.t >= b.t ASOF LEFT JOIN f a ON g.t <= a.t)
SELECT round(t, 3) AS gold_t, round(CASE WHEN p IS NULL THEN n WHEN n IS NULL OR t - p <= n - t THEN p ELSE n END, 3) AS nearest_t FROM n""",
)
def nearest_hot_video(spark, sf):
    """All events in one video, cut by time over tasks."""
    e = seconds(read(spark, sf, "events")).withColumn("video", F.lit(0))
    gold, found = e.where("event_id % 10 = 0").select("video", F.col("t").alias("gold_t")), e.where("event_id % 10 <> 0").select("video", "t")
    return iv.nearest_spread(gold, found, "video").select(F.round("gold_t", 3).alias("gold_t"), F.round("nearest_t", 3).alias("nearest_t"))


@query(
    "control_group",
    f"""WITH e AS (SELECT user_id, {T_SQL} / 3600 AS t FROM events), d AS (SELECT user_id, max(t) AS duration FROM e GROUP BY user_id),
s AS (SELECT user_id, round_even(duration * i / 9, 1) AS x FROM d, range(1, 9) AS r(i)),
n AS (SELECT user_id, x, arg_min(t, (abs(t - x), t)) AS t FROM s JOIN e USING (user_id) GROUP BY ALL)
SELECT 'case-' || user_id AS case_id, list_sort(list(DISTINCT round(t, 6))) AS retrieved_timestamps, 'uniform_sample_vqa' AS action FROM n GROUP BY user_id""",
)
def control_group(spark, sf):
    e = seconds(read(spark, sf, "events")).select(F.col("user_id").alias("video_id"), (F.col("t") / 3600).alias("t"))
    cases = e.groupBy("video_id").agg(F.max("t").alias("duration")).withColumn("case_id", F.concat(F.lit("case-"), F.col("video_id").cast("string")))
    made = iv.control_group(cases, e, 8)
    return made.select("case_id", F.transform("retrieved_timestamps", lambda x: F.round(x, 6)).alias("retrieved_timestamps"), F.col("agent_actions")[0].alias("action"))


@query(
    "slide_chunks",
    """WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE left(text, 40) END AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT source AS video, 'slide_' || lpad(i::VARCHAR, 5, '0') AS chunk_id, trim(text) AS text, doc_id::DOUBLE AS t_start, i::INT AS slide_id FROM d WHERE trim(coalesce(text, '')) <> ''""",
)
def slide_chunks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("video"), F.col("doc_id").alias("timestamp"), F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.substring("text", 1, 40)).alias("text"))
    return iv.chunk_slides(d, "video", "timestamp").select("video", "chunk_id", "text", "t_start", "slide_id")


@query(
    "ingest_counts",
    """SELECT count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0) AS rebound, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0 AND event_id % 3 <> 0 AND event_id % 13 <> 0) AS processed,
 count(*) FILTER (event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0 OR event_id % 3 <> 0 AND event_id % 13 = 0) AS skipped,
 count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0) AS kept_rows, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 = 0) AS without_file FROM events""",
)
def ingest_counts(spark, sf):
    """Events as entries of a manifest: some without a case, a file, a digest, some done before. Counts come from the job that writes the rows."""
    i = F.col("event_id")
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("c"), i).alias("case_id"), F.concat(F.lit("v"), i).alias("video"), F.when(i % 11 != 0, F.md5(i.cast("string"))).alias("content_id"))
    cases = e.where(i % 7 != 0).select("case_id", "event_id")
    known = e.where(i % 5 != 0).select("video", F.concat(F.lit("/v/"), "video").alias("path"), "content_id")
    status = e.where((i % 3 == 0) & F.col("content_id").isNotNull()).select("content_id", F.lit("done").alias("status"))
    path = scratch(spark, "ingest")
    counts = files.ingest(cases, e.select("case_id", "video"), known, status, path, F.when(i % 13 == 0, "broken"))
    written = spark.read.parquet(path).withColumn("kept", F.col("kept").cast("boolean"))
    return written.agg(
        *[F.lit(counts[k]).cast("long").alias(k) for k in ("rebound", "processed", "skipped")], F.count_if(F.col("kept")).alias("kept_rows"), F.count_if(~F.col("kept") & (F.col("reason") == "file_missing")).alias("without_file")
    )


@query(
    "ingest_status",
    """SELECT 'v' || event_id AS video_id, CASE WHEN event_id % 4 = 0 THEN 'already-done' WHEN event_id % 6 <> 1 AND event_id % 10 <> 3 AND event_id % 9 = 0 THEN 'FAILED: source missing' WHEN event_id % 8 = 3 THEN 'FAILED: ValueError: no audio' ELSE 'done' END AS status FROM events""",
)
def ingest_status(spark, sf):
    i = F.col("event_id")
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("v"), i).alias("video_id"))
    made = files.ingest_status(e, e.where((i % 6 == 1) | (i % 10 == 3)), e.where(i % 9 != 0), e.where(i % 4 == 0), F.when(i % 8 == 3, "ValueError: no audio"))
    return made.select("video_id", "status")


_SHARES = """z AS (SELECT source AS stratum, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY source), t AS (SELECT sum(size) AS total FROM z),
p AS (SELECT stratum, size, %d.0 * size / total AS quota, least(size, greatest(1, floor(%d.0 * size / total)))::BIGINT AS base FROM z, t),
l AS (SELECT *, greatest(0, %d - sum(base) OVER ())::BIGINT AS rest FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN base < size THEN 0 ELSE 1 END, quota - base DESC, stratum) AS place FROM l),
h AS (SELECT stratum, size, base + CASE WHEN place <= rest AND base < size THEN 1 ELSE 0 END AS share FROM r)"""


@query("stratified_shares", f"WITH {_SHARES % (70, 70, 70)} SELECT * FROM h")
def stratified_shares(spark, sf):
    docs = read(spark, sf, "documents").where("source is not null")
    return allocate(docs.withColumnRenamed("source", "stratum"), "stratum", 70)


@query(
    "stratified_sample",
    f"""WITH {_SHARES % (12, 12, 12)}, d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':3'), doc_id) AS r FROM documents WHERE source IS NOT NULL)
SELECT doc_id, source FROM d JOIN h ON source = stratum WHERE r <= share""",
)
def stratified_sample(spark, sf):
    """Twelve places for more sources than that: each has one."""
    docs = read(spark, sf, "documents").where("source is not null").select("doc_id", "source")
    return allocated_sample(docs, "source", "doc_id", 12, 3)


@query(
    "detect_scenes",
    f"""WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 200)) AS p FROM embeddings WHERE label % 5 <> 4),
d AS (SELECT label, vec_id, row_number() OVER w - 1 AS n, p, lag(p) OVER w AS b FROM f WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT label, vec_id, n FROM d WHERE b IS NOT NULL AND list_sum(list_transform(list_zip(p, b), lambda z: abs(z[1] - z[2]))) / len(p) >= {iv.SCENE_THRESHOLD}),
t AS (SELECT label, vec_id::DOUBLE AS s FROM c UNION ALL SELECT DISTINCT label, 0.0 FROM embeddings),
v AS (SELECT label, max(vec_id) + 1.0 AS duration FROM embeddings GROUP BY label),
o AS (SELECT label, s, lead(s) OVER (PARTITION BY label ORDER BY s) AS e, count(*) OVER (PARTITION BY label) AS m, row_number() OVER (PARTITION BY label ORDER BY s) - 1 AS i FROM t)
SELECT label, i::INT AS scene_id, s AS start, coalesce(e, duration) AS end_ FROM o JOIN v USING (label) WHERE m >= 3
UNION ALL SELECT label, i::INT, i * 10.0, least(i * 10.0 + 10, duration) FROM (SELECT label, duration, unnest(range(ceil(duration / 10)::BIGINT)) AS i FROM v JOIN o USING (label) WHERE m < 3 AND o.i = 0)""",
)
def detect_scenes(spark, sf):
    """Vectors of a label as pixels of a video's frames; labels without frames are cut evenly. Frames may follow each other at once."""
    e = read(spark, sf, "embeddings")
    pixels = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 200))
    frames = e.where(F.col("label") % 5 != 4).select("label", "vec_id", pixels.alias("pixels"))
    durations = e.groupBy("label").agg((F.max("vec_id") + 1.0).alias("duration"))
    return iv.detect_scenes(frames, durations, "label", "vec_id", least_frames=1).select("label", "scene_id", "start", F.col("end").alias("end_"))


@query("first_cases", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_cases(spark, sf):
    from ..datasets import first_cases as first

    return first(read(spark, sf, "documents").select("doc_id"), "doc_id", 25)
