"""Interval, nearest and windowing queries. Videos are users, evidence kinds are event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sign_hash
from ..operators import intervals as iv
from ..operators import merge
from .registry import query, read

EPOCH = 1704067200.0
T_SQL = f"(epoch(ts) - {EPOCH})"


def seconds(df):
    t = F.unix_micros("ts") / 1e6 if dict(df.dtypes)["ts"] == "timestamp" else F.unix_micros(F.to_timestamp_ltz("ts")) / 1e6
    return df.withColumn("t", t - EPOCH)


def spans(df):
    """Every event with a day of its own length as evidence span."""
    return seconds(df).withColumn("t_start", F.col("t")).withColumn("t_end", F.col("t") + F.floor("value") % 600)


SPANS = f"sp AS (SELECT *, {T_SQL} AS t, {T_SQL} AS t_start, {T_SQL} + floor(value) % 600 AS t_end FROM events)"


@query(
    "normalize_segments",
    f"""WITH {SPANS} SELECT event_id, round(least(t_end - 300, t_start), 3) AS t_start, round(greatest(t_end - 300, t_start), 3) AS t_end, trim(regexp_replace(event_type || '  ' || props, '\\s+', ' ', 'g')) AS text FROM sp""",
)
def normalize_segments(spark, sf):
    from ..functions.text import squeeze

    e = spans(read(spark, sf, "events"))
    a, b = F.col("t_start"), F.col("t_end") - 300
    return e.select("event_id", F.round(F.least(a, b), 3).alias("t_start"), F.round(F.greatest(a, b), 3).alias("t_end"), squeeze(F.concat("event_type", F.lit("  "), "props")).alias("text"))


@query("uniform_windows", f"""WITH d AS (SELECT user_id, (max({T_SQL}) - min({T_SQL})) / 3600 AS duration FROM events GROUP BY user_id),
w AS (SELECT user_id, duration, unnest(range(0, ceil(duration / 10)::INT)) AS scene_id FROM d WHERE duration > 0)
SELECT user_id, scene_id::INT AS scene_id, round(scene_id * 10.0::DOUBLE, 3) AS start_s, round(least(scene_id * 10.0 + 10, duration), 3) AS end_s FROM w""")
def uniform_windows(spark, sf):
    w = iv.uniform_windows(_durations(spark, sf))
    return w.select("user_id", "scene_id", F.round("start", 3).alias("start_s"), F.round("end", 3).alias("end_s"))


def _durations(spark, sf):
    e = seconds(read(spark, sf, "events"))
    return e.groupBy("user_id").agg(((F.max("t") - F.min("t")) / 3600).alias("duration"))


@query("dense_time_grid", f"""WITH d AS (SELECT user_id, (max({T_SQL}) - min({T_SQL})) / 3600 AS duration FROM events GROUP BY user_id)
SELECT user_id, count(*) AS frames, max(i)::DOUBLE AS last_ts FROM (SELECT user_id, unnest(range(0, ceil(duration)::INT)) AS i FROM d WHERE duration > 0) GROUP BY user_id""")
def dense_time_grid(spark, sf):
    g = iv.time_grid(_durations(spark, sf))
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.max("ts").alias("last_ts"))


@query("uniform_sample_nearest", f"""WITH e AS (SELECT user_id, {T_SQL} / 3600 AS t FROM events), d AS (SELECT user_id, max(t) AS duration FROM e GROUP BY user_id),
s AS (SELECT user_id, duration * i / 6 AS sample_t FROM d, range(1, 6) AS r(i)),
j AS (SELECT s.user_id, sample_t, t, row_number() OVER (PARTITION BY s.user_id, sample_t ORDER BY abs(t - sample_t), t) AS rn FROM s JOIN e USING (user_id))
SELECT user_id, round(sample_t, 6) AS sample_t, round(t, 6) AS nearest_t FROM j WHERE rn = 1""")
def uniform_sample_nearest(spark, sf):
    e = seconds(read(spark, sf, "events")).select("user_id", (F.col("t") / 3600).alias("t"))
    d = e.groupBy("user_id").agg(F.max("t").alias("duration"))
    n = iv.nearest(iv.uniform_samples(d, 5), e, "user_id", "sample_t")
    return n.select("user_id", F.round("sample_t", 6).alias("sample_t"), F.round("nearest_t", 6).alias("nearest_t"))


_BITS = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN 1 ELSE 0 END)::HUGEINT * {2**i}::HUGEINT" for i in range(64))


@query("slide_change_detect", f"""WITH s AS (SELECT label, vec_id, embedding, {_BITS} AS h, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
p AS (SELECT *, lag(h) OVER w AS ph, lag(embedding) OVER w AS pe FROM s WHERE i % 4 = 0 WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id FROM p WHERE ph IS NULL OR (bit_count(xor(h, ph)) >= 8 AND list_avg(list_transform(list_zip(embedding, pe), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) * 100 >= 7.5)""")
def slide_change(spark, sf):
    e = read(spark, sf, "embeddings")
    f = e.select("label", "vec_id", sign_hash("embedding").alias("h"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("gray"))
    return iv.change_points(f, "label", "vec_id", "h", "gray").select("label", "vec_id")


@query("nearby_interval_join", f"""WITH {SPANS}, a AS (SELECT user_id, event_id AS at_id, t FROM sp WHERE event_type = 'purchase')
SELECT a.at_id, s.event_type, count(*) AS n, round(min(s.t_start), 3) AS first_start FROM a JOIN sp s ON a.user_id = s.user_id AND s.t_start <= a.t + 900 AND s.t_end >= greatest(a.t - 900, 0) GROUP BY a.at_id, s.event_type""")
def nearby(spark, sf):
    e = spans(read(spark, sf, "events"))
    at = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at_id"), "t")
    n = iv.overlapping(e.drop("t"), "user_id", at, 900.0)
    return n.groupBy("at_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t_start"), 3).alias("first_start"))


@query("window_frame_counts", f"""WITH {SPANS}, w AS (SELECT user_id, event_id AS window_id, t AS s, t + 7200 AS e FROM sp WHERE event_type = 'purchase')
SELECT window_id, count(sp.event_id) AS frames FROM w LEFT JOIN sp ON sp.user_id = w.user_id AND sp.t BETWEEN s AND e GROUP BY window_id""")
def window_counts(spark, sf):
    e = spans(read(spark, sf, "events"))
    w = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("t").alias("start"), (F.col("t") + 7200).alias("end"))
    hits = iv.points_in_intervals(e.select("user_id", F.col("t").alias("ts")), w, "user_id")
    counts = hits.groupBy("window_id").agg(F.count(F.lit(1)).alias("frames"))
    return w.select("window_id").join(counts, "window_id", "left").select("window_id", F.coalesce("frames", F.lit(0)).alias("frames"))


@query("scene_gated_semi", f"""WITH {SPANS} SELECT event_id FROM sp f WHERE EXISTS (SELECT 1 FROM sp s WHERE s.event_type = 'purchase' AND s.user_id = f.user_id AND f.t BETWEEN s.t_start AND s.t_end + 1800)""")
def scene_gated(spark, sf):
    e = spans(read(spark, sf, "events"))
    s = e.where("event_type = 'purchase'").select("user_id", F.col("t_start").alias("start"), (F.col("t_end") + 1800).alias("end"))
    return iv.points_in_intervals(e.select("user_id", "event_id", F.col("t").alias("ts")), s, "user_id", how="left_semi").select("event_id")


@query("nearest_timestamp", f"""WITH {SPANS}, g AS (SELECT user_id, event_id, t FROM sp WHERE event_type = 'purchase'), f AS (SELECT user_id, t FROM sp WHERE event_type = 'click'),
j AS (SELECT g.user_id, g.event_id, g.t, f.t AS ft, row_number() OVER (PARTITION BY g.event_id ORDER BY abs(g.t - f.t), f.t) AS rn FROM g LEFT JOIN f USING (user_id))
SELECT user_id, round(t, 3) AS gold_t, round(ft, 3) AS nearest_t, round(abs(t - ft), 3) AS distance FROM j WHERE rn = 1""")
def nearest_timestamp(spark, sf):
    e = seconds(read(spark, sf, "events"))
    g = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("gold_t"))
    n = iv.nearest(g, e.where("event_type = 'click'").select("user_id", "t"), "user_id")
    return n.select("user_id", *[F.round(c, 3).alias(c) for c in ("gold_t", "nearest_t", "distance")])


@query("retrieval_recall", f"""WITH {SPANS}, g AS (SELECT user_id, event_id, t FROM sp WHERE event_type = 'purchase'), f AS (SELECT user_id, t FROM sp WHERE event_type = 'click'),
j AS (SELECT g.user_id, g.event_id, min(abs(g.t - f.t)) AS d FROM g LEFT JOIN f USING (user_id) GROUP BY ALL)
SELECT user_id, round(avg(CASE WHEN d <= 7200 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(d), 3) AS mean_distance, avg(CASE WHEN d <= 7200 THEN 1.0 ELSE 0.0 END) = 1 AS passed FROM j GROUP BY user_id""")
def retrieval_recall(spark, sf):
    from ..plans.evaluation import evaluate_retrieval

    e = seconds(read(spark, sf, "events"))
    g = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("gold_t"))
    r = evaluate_retrieval(g, e.where("event_type = 'click'").select("user_id", "t"), "user_id", 7200.0)
    return r.select("user_id", F.round("recall", 6).alias("recall"), F.round("mean_distance", 3).alias("mean_distance"), "passed")


@query("chunk_window_4_1", """WITH s AS (SELECT conv_id, turn, trim(text) AS text, turn * 5.0::DOUBLE AS t_start, turn * 5.0::DOUBLE + 4 AS t_end, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
m AS (SELECT *, (i // 3) * 3 AS s FROM s UNION ALL SELECT *, i - 3 AS s FROM s WHERE i % 3 = 0 AND i > 0)
SELECT conv_id, printf('transcript_%05d', s) AS chunk_id, trim(string_agg(text, ' ' ORDER BY i)) AS text, min(t_start) AS t_start, arg_max(t_end, i) AS t_end, count(*) AS members FROM m GROUP BY conv_id, s HAVING trim(string_agg(text, ' ' ORDER BY i)) <> ''""")
def chunk_window(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 5.0).alias("t_start"), (F.col("turn") * 5.0 + 4).alias("t_end"))
    return iv.chunk_windows(c, "conv_id", "turn").select("conv_id", "chunk_id", "text", "t_start", "t_end", "members")


@query("merge_frames", f"""WITH {SPANS} SELECT user_id, event_id FROM sp QUALIFY row_number() OVER (PARTITION BY user_id, floor(t / 3600) ORDER BY event_id) = 1""")
def merge_frames(spark, sf):
    e = seconds(read(spark, sf, "events")).select("user_id", "event_id", F.floor(F.col("t") / 3600).cast("double").alias("ts"))
    return merge.merge_frames(e, "event_id", "user_id").select("user_id", "event_id")


@query("merge_scenes", f"""WITH {SPANS} SELECT user_id, event_id FROM sp QUALIFY row_number() OVER (PARTITION BY user_id, floor(t / 86400), floor(value) ORDER BY event_id) = 1""")
def merge_scenes(spark, sf):
    e = seconds(read(spark, sf, "events")).select("user_id", "event_id", F.floor(F.col("t") / 86400).cast("double").alias("start"), F.floor("value").cast("double").alias("end"))
    return merge.merge_scenes(e, "event_id", "user_id").select("user_id", "event_id")


@query("merge_text", """SELECT doc_id FROM (SELECT doc_id, floor(doc_id / 7) AS a, row_number() OVER (PARTITION BY lang, floor(doc_id / 50), substr(text, 1, 80) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1 ORDER BY floor(doc_id / 50), doc_id LIMIT 20""")
def merge_text(spark, sf):
    bucket = F.floor(F.col("doc_id") / 50).cast("double")
    d = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"), bucket.alias("t_start"), bucket.alias("t_end"), "text", F.col("n_chars").alias("score"))
    return merge.merge_text(d, "doc_id").select("doc_id")


@query("timeline_union", f"""WITH {SPANS} SELECT 'scene' AS entry, event_id, round(t_start, 3) AS at, round(t_end, 3) AS end_s FROM sp WHERE event_type = 'purchase' UNION ALL SELECT 'frame', event_id, round(t, 3), NULL FROM sp WHERE event_type = 'click'""")
def timeline_union(spark, sf):
    e = spans(read(spark, sf, "events"))
    s = e.where("event_type = 'purchase'").select("event_id", F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    f = e.where("event_type = 'click'").select("event_id", F.col("t").alias("ts"))
    return merge.timeline(s, f).select("entry", "event_id", F.round("at", 3).alias("at"), F.round("end", 3).alias("end_s"))


@query("video_profile", f"""WITH e AS (SELECT user_id, (max({T_SQL}) - min({T_SQL})) / 3600 AS duration, count(*) FILTER (event_type = 'click') AS scenes, count(*) FILTER (event_type = 'view') AS segments,
 count(*) FILTER (event_type = 'purchase') AS slides, sum(length(props)) FILTER (event_type = 'purchase') AS ocr FROM events GROUP BY user_id),
m AS (SELECT user_id, duration, duration / 60.0 AS m, scenes, segments, slides, coalesce(ocr, 0) AS ocr FROM e),
d AS (SELECT *, scenes / m AS sc, segments / m AS sg, slides / m AS sl, ocr / m AS oc FROM m)
SELECT user_id, CASE WHEN duration >= 1 THEN round(sc, 2) END AS scenes_pm, CASE WHEN duration >= 1 THEN round(oc, 1) END AS ocr_pm,
 CASE WHEN duration >= 1 THEN CASE WHEN sl >= 2 AND oc >= 100 THEN 'slide_heavy' WHEN segments > 0 AND sl < 1 AND sg >= 5 THEN 'speech_heavy' WHEN sl < 0.5 AND (segments = 0 OR sg < 2) AND sc >= 3 THEN 'visual_dynamic' ELSE 'mixed' END END AS profile FROM d""")
def video_profile(spark, sf):
    from ..plans.planner import video_profile as columns

    e = seconds(read(spark, sf, "events"))
    kind = lambda k: F.col("event_type") == k
    s = e.groupBy("user_id").agg(
        ((F.max("t") - F.min("t")) / 3600).alias("duration"), F.count_if(kind("click")).alias("scenes"), F.count_if(kind("view")).alias("segments"),
        F.count_if(kind("purchase")).alias("slides"), F.coalesce(F.sum(F.when(kind("purchase"), F.length("props"))), F.lit(0)).alias("ocr_chars"),
    )
    s = s.withColumn("has_transcript", F.col("segments") > 0).withColumn("has_slides", F.col("slides") > 0)
    scenes, _, _, ocr, profile = columns()
    return s.select("user_id", scenes.alias("scenes_pm"), ocr.alias("ocr_pm"), profile.alias("profile"))
