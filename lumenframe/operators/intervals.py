"""Joins and windows over seconds.

Interval joins always carry an equi key. Where a key may hold many rows the time
bucket is part of it: each interval is listed under every bucket it touches, so a
point meets only intervals of its own bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import stored


def points_in_intervals(points: DataFrame, spans: DataFrame, key: str, ts: str = "ts", start: str = "start", end: str = "end", bucket: float = 3600.0, how: str = "inner") -> DataFrame:
    """Points joined to the closed intervals of the same key that hold them."""
    p = points.withColumn("bucket", F.floor(F.col(ts) / bucket))
    s = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    s = s.withColumnRenamed(key, "span_key")
    on = (F.col(key) == F.col("span_key")) & (p.bucket == s.bucket) & (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))
    out = p.join(s, on, how)
    return out.drop("bucket", "span_key") if how == "inner" else out.drop("bucket")


def overlapping(spans: DataFrame, key: str, at: DataFrame, radius: float, bucket: float = 3600.0) -> DataFrame:
    """For each ``(key, t)`` of ``at``: spans of the key that overlap ``[max(0, t - radius), t + radius]``, closed."""
    lo, hi = F.greatest(F.col("t") - radius, F.lit(0.0)), F.col("t") + radius
    a = at.withColumn("lo", lo).withColumn("hi", hi).withColumnRenamed(key, "at_key")
    a = a.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    s = spans.withColumn("sb", F.explode(F.sequence(F.floor(F.col("t_start") / bucket), F.floor(F.col("t_end") / bucket))))
    hit = (F.col(key) == F.col("at_key")) & (F.col("b") == F.col("sb")) & (F.col("t_start") <= F.col("hi")) & (F.col("t_end") >= F.col("lo"))
    # a pair meets in each bucket that both touch: it counts in the first of them
    first = F.col("b") == F.floor(F.greatest(F.col("t_start"), F.col("lo")) / bucket)
    return s.join(a, hit & first).drop("b", "sb", "at_key")


def _pick(rows: DataFrame, key: str, gold_t: str) -> DataFrame:
    """Of rows with the previous time ``p`` and the next time ``n``: the nearer one, the earlier on a tie."""
    dp, dn = F.abs(F.col("x") - F.col("p")), F.abs(F.col("n") - F.col("x"))
    pick = F.when(F.col("p").isNull(), F.col("n")).when(F.col("n").isNull() | (dp <= dn), F.col("p")).otherwise(F.col("n"))
    return rows.select(key, F.col("x").alias(gold_t), pick.alias("nearest_t"), F.abs(F.col("x") - pick).alias("distance"))


def _both(gold: DataFrame, found: DataFrame, key: str, gold_t: str, t: str) -> DataFrame:
    g = gold.select(key, F.col(gold_t).alias("x"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("is_gold"))
    return g.unionByName(found.select(key, F.col(t).alias("x"), F.col(t).cast("double").alias("v"), F.lit(0).alias("is_gold")))


def nearest(gold: DataFrame, found: DataFrame, key: str, gold_t: str = "gold_t", t: str = "t") -> DataFrame:
    """Each gold time with its nearest found time of the same key (the earlier on a tie), null if none.

    A union sorted by time and two running windows: no pair of rows is ever formed. A key is one task; ``nearest_spread``
    has no such bound.
    """
    back = W.partitionBy(key).orderBy("x", "is_gold").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.col("x").desc(), "is_gold").rowsBetween(W.unboundedPreceding, 0)
    both = _both(gold, found, key, gold_t, t).withColumn("p", F.last("v", True).over(back)).withColumn("n", F.last("v", True).over(ahead)).where("is_gold = 1")
    return _pick(both, key, gold_t)


def nearest_spread(gold: DataFrame, found: DataFrame, key: str, gold_t: str = "gold_t", t: str = "t") -> DataFrame:
    """``nearest`` where a key may hold any number of rows: it is cut by time over tasks, and values are carried across the cuts.

    Rows are range-partitioned by (key, time) and written once. Windows run within a partition; of keys that several partitions
    hold, the last and the first found time of each partition go to the others. A partition has two such keys
    at most, so what is broadcast has twice as many rows as there are partitions.
    """
    rows = _both(gold, found.select(key, t).distinct(), key, gold_t, t)
    rows = rows.withColumn("deal", F.when(F.col("is_gold") == 1, F.monotonically_increasing_id()).otherwise(0))
    order = [F.col(key), F.col("x"), F.col("is_gold"), F.col("deal")]
    cut = stored(stored(rows, "times").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "cut")
    back = W.partitionBy("part", key).orderBy("x", "is_gold").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("part", key).orderBy(F.col("x").desc(), "is_gold").rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("p", F.last("v", True).over(back)).withColumn("n", F.last("v", True).over(ahead)).where("is_gold = 1")
    ends = cut.groupBy(key, "part").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    whole = W.partitionBy(key)
    ends = ends.withColumn("many", F.count(F.lit(1)).over(whole)).where("many > 1")
    before, after = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1), whole.orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(key, "part", F.max("last").over(before).alias("p0"), F.min("first").over(after).alias("n0"))
    full = local.join(F.broadcast(carried), [key, "part"], "left").withColumn("p", F.coalesce("p", "p0")).withColumn("n", F.coalesce("n", "n0"))
    return _pick(full, key, gold_t)


def chunk_windows(segments: DataFrame, key: str, order: str, text: str = "text", window: int = 4, overlap: int = 1) -> DataFrame:
    """Ordinal windows: starts 0, step, 2 * step, ...; tails stay. ``t_end`` is that of the last member."""
    step = window - overlap
    i = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    rows = segments.withColumn("i", i)
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit((window - 1) // step)), lambda j: (F.floor(F.col("i") / step) - j) * step), lambda s: (s >= 0) & (F.col("i") < s + window))
    rows = rows.withColumn("s", F.explode(starts))
    made = rows.groupBy(key, "s").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim(text).alias("x")))), lambda m: m["x"]), " ")).alias("text"),
        F.min("t_start").alias("t_start"), F.max(F.struct("i", "t_end"))["t_end"].alias("t_end"), F.count(F.lit(1)).alias("members"),
    )
    return made.where("text <> ''").withColumn("chunk_id", F.format_string("transcript_%05d", F.col("s"))).drop("s")


def uniform_windows(df: DataFrame, duration: str = "duration", size: float = 10.0) -> DataFrame:
    """Tumbling windows over ``[0, duration]``; the last is clipped."""
    n = F.ceil(F.col(duration) / size).cast("int")
    rows = df.where(F.col(duration) > 0).withColumn("scene_id", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("start", F.col("scene_id") * size).withColumn("end", F.least(F.col("start") + size, F.col(duration)))


def time_grid(df: DataFrame, fps: float = 1.0, duration: str = "duration") -> DataFrame:
    n = F.ceil(F.col(duration) * fps).cast("int")
    return df.where(F.col(duration) > 0).withColumn("ts", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i / fps, 1))))


def uniform_samples(df: DataFrame, n: int, duration: str = "duration") -> DataFrame:
    """``n`` interior points at equal steps; the middle for one."""
    return df.where(F.col(duration) > 0).withColumn("sample_t", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col(duration) * i / (n + 1))))


def change_points(frames: DataFrame, key: str | None, order: str, hash_col: str, gray: str, step: int = 4, least_hash: int = 8, least_diff: float = 7.5) -> DataFrame:
    """Every ``step``-th frame; the first stays, others if hash and mean difference to the sample before are large."""
    from ..functions.numeric import hamming, mean_abs_diff

    w = W.partitionBy(*([key] if key else [])).orderBy(order)
    sampled = frames.withColumn("i", F.row_number().over(w) - 1).where(F.col("i") % step == 0)
    both = sampled.withColumn("ph", F.lag(hash_col).over(w)).withColumn("pg", F.lag(gray).over(w))
    keep = F.col("ph").isNull() | ((hamming(hash_col, "ph") >= least_hash) & (mean_abs_diff(gray, "pg") >= least_diff))
    return both.where(keep).drop("ph", "pg")


def chunk_slides(slides: DataFrame, key: str, order: str) -> DataFrame:
    """Slides with text as chunks: ``chunk_id`` counts all slides of the key, blank ones too; missing times, ids and sources get defaults.

    Optional columns: ``t_start``, ``t_end``, ``timestamp``, ``source``, ``slide_id``, ``filename``.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in slides.columns else F.lit(None).cast(kind)
    i = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    at = F.coalesce(have("timestamp", "double"), F.lit(0.0))
    some = lambda c, default: F.when(F.coalesce(have(c, "string"), F.lit("")) == "", default).otherwise(have(c, "string"))
    rows = slides.withColumn("_i", i).withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    return rows.select(
        key, F.format_string("slide_%05d", "_i").alias("chunk_id"), "text", F.coalesce(have("t_start", "double"), at).alias("t_start"), F.coalesce(have("t_end", "double"), at).alias("t_end"),
        some("source", F.lit("rapidocr")).alias("source"), F.coalesce(have("slide_id", "int"), F.col("_i")).alias("slide_id"), some("filename", F.lit("")).alias("filename"),
    )


def control_group(cases: DataFrame, dense: DataFrame, n: int, key: str = "video_id", t: str = "t") -> DataFrame:
    """Predictions without retrieval: ``n`` frames of every case at equal steps, ``(case_id, retrieved_timestamps, agent_actions, control_group)``.

    ``cases`` has ``case_id``, ``key`` and ``duration``. The dense frame nearest to each step counts once; cases without frames are left out.
    """
    steps = uniform_samples(cases.select(key, "duration").distinct(), n).withColumn("sample_t", F.bround("sample_t", 1))
    near = nearest(steps, dense, key, "sample_t", t).where("nearest_t is not null")
    times = near.groupBy(key).agg(F.array_sort(F.collect_set("nearest_t")).alias("retrieved_timestamps"))  # at most n
    actions = F.array(F.lit("uniform_sample_vqa"))
    return cases.select("case_id", key).join(times, key).select("case_id", "retrieved_timestamps", actions.alias("agent_actions"), F.lit("no_retrieval").alias("control_group"))


#: Mean difference of pixels from which on a frame starts a scene, frames that a scene has at least, and scenes below which a video is cut evenly.
SCENE_THRESHOLD, SCENE_FRAMES, FEWEST_SCENES = 27.0, 15, 3


def content_change(frames: DataFrame, key: str, ts: str = "ts", pixels: str = "pixels") -> DataFrame:
    """``(key, ts, change)``: the mean absolute difference of a frame's pixels to those of the frame before, null for the first."""
    w = W.partitionBy(key).orderBy(ts)
    rows = frames.select(key, ts, F.col(pixels).alias("_a"), F.lag(pixels).over(w).alias("_b"))
    apart = F.zip_with("_a", "_b", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    size = F.size("_a")
    return rows.select(key, ts, F.when(F.col("_b").isNotNull() & (size > 0), F.aggregate(apart, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / size).alias("change"))


def detect_scenes(
    frames: DataFrame, durations: DataFrame, key: str, ts: str = "ts", pixels: str = "pixels", threshold: float = SCENE_THRESHOLD, least_frames: int = SCENE_FRAMES, fewest: int = FEWEST_SCENES,
    size: float = 10.0,
) -> DataFrame:
    """``(key, scene_id, start, end)``: scenes between content changes; a video with fewer than ``fewest`` is cut evenly.

    A change cuts if it reaches ``threshold`` and ``least_frames`` frames or more lie since the last cut; cuts are chosen
    greedily in order, which is a running state over a video's changed frames alone. ``durations`` has ``key`` and ``duration``: the last scene
    ends there. Videos without frames are cut evenly too.
    """
    w = W.partitionBy(key).orderBy(ts)
    numbered = content_change(frames, key, ts, pixels).withColumn("n", F.row_number().over(w) - 1)
    changed = numbered.where(F.col("change") >= threshold)
    # the fold keeps the last cut's number: frames that come too early after it don't cut
    listed = changed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("n"), F.col(ts).cast("double").alias("t")))).alias("c"))
    none = F.array().cast("array<struct<n: int, t: double>>")
    start = F.struct(F.lit(0).alias("last"), none.alias("cuts"))
    step = lambda s, x: F.when(x["n"] - s["last"] >= least_frames, F.struct(x["n"].alias("last"), F.concat(s["cuts"], F.array(F.struct(x["n"].alias("n"), x["t"].alias("t")))).alias("cuts"))).otherwise(s)
    cuts = listed.select(key, F.aggregate("c", start, step)["cuts"].alias("cuts"))
    rows = durations.select(key, F.col("duration").cast("double").alias("duration")).join(cuts, key, "left")
    edges = F.concat(F.array(F.lit(0.0)), F.transform(F.coalesce("cuts", none), lambda c: c["t"]))
    inside = F.filter(edges, lambda x: x < F.col("duration"))
    rows = rows.withColumn("edges", inside)
    ends = lambda i: F.coalesce(F.get(F.col("edges"), i + 1), F.col("duration"))
    found = rows.where(F.size("edges") >= fewest).select(key, F.posexplode(F.transform("edges", lambda x, i: F.struct(x.alias("start"), ends(i).alias("end")))).alias("scene_id", "s")).select(key, "scene_id", "s.start", "s.end")
    even = uniform_windows(rows.where(F.size("edges") < fewest), size=size).select(key, "scene_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return found.unionByName(even)
