"""Evidence merging: first or best row per rounded key, timelines, latest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import even_indices


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merge_scenes(df: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """One row per (start, end) at two decimals, the first seen; by start."""
    keys = ([F.col(by)] if by else []) + [F.bround("start", 2), F.bround("end", 2)]
    return first_per_key(df, keys, [order])


def merge_frames(df: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """One row per timestamp at one decimal, the first seen."""
    return first_per_key(df, ([F.col(by)] if by else []) + [F.bround("ts", 1)], [order])


def merge_text(df: DataFrame, order: str, most: int | None = 20, by: str | None = None) -> DataFrame:
    """One row per (kind, start, end, first 80 characters), the best score, then the first; the earliest ``most``, of each ``by`` if given."""
    keys = [*([by] if by else []), "kind", F.bround("t_start", 2), F.bround("t_end", 2), F.substring("text", 1, 80)]
    kept = first_per_key(df, keys, [F.col("score").desc(), F.col(order)])
    if most is None or by is None:
        return kept if most is None else kept.orderBy("t_start", "t_end", order).limit(most)
    return kept.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("t_start", "t_end", order))).where(F.col("_r") <= most).drop("_r")


def capped_frames(rows: DataFrame, by: str, ts: str, order: str, limit: int, *payload: str) -> DataFrame:
    """Of each session one frame a tenth of a second, the first seen, evenly thinned to ``limit``: ``(by, at, payload...)`` rows.

    Duplicates combine before they move; what a session keeps is chosen by rank, so no array holds more than the cap.
    """
    first = F.min_by(F.struct(*payload), order) if payload else F.min(order)
    once = rows.where(F.col(ts).isNotNull()).groupBy(by, F.bround(ts, 1).alias("at")).agg(first.alias("_p"))
    ranked = once.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy("at")) - 1)
    sizes = once.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.select(by, F.explode(even_indices("_n", limit)).alias("_i")).distinct()
    found = ranked.join(kept, [by, "_i"], "left_semi")
    return found.select(by, "at", *([F.col("_p")[c].alias(c) for c in payload]))


def capped_scenes(rows: DataFrame, by: str, start: str, end: str, order: str, *payload: str) -> DataFrame:
    """Of each session one scene a pair of start and end at two decimals, the first seen, as rows."""
    good = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    once = good.groupBy(by, F.bround(start, 2), F.bround(end, 2)).agg(F.min_by(F.struct(start, end, *payload), order).alias("_p"))
    return once.select(by, "_p.*")


def capped_texts(rows: DataFrame, by: str, order: str, limit: int | None = 20) -> DataFrame:
    """Of each session one text a (kind, start, end, first 80 characters), the best score and then the first; the earliest ``limit`` by kind and time, as rows.

    ``rows`` has ``kind``, ``t_start``, ``t_end``, ``text`` and ``score``. Duplicates combine before they move, and a group limit
    cuts each task's rows before the sessions meet.
    """
    good = rows.where((F.coalesce("kind", F.lit("")) != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    start = F.bround(F.coalesce("t_start", F.lit(0.0)), 2)
    good = good.select(by, "kind", start.alias("t_start"), F.bround(F.coalesce("t_end", start), 2).alias("t_end"), "text", F.coalesce("score", F.lit(0.0)).alias("score"), F.col(order).alias("_o"))
    best = F.max_by(F.struct("text", "score", "_o"), F.struct(F.col("score"), -F.col("_o")))
    once = good.groupBy(by, "kind", "t_start", "t_end", F.substring(F.trim("text"), 1, 80)).agg(best.alias("_p")).select(by, "kind", "t_start", "t_end", "_p.text", "_p.score", "_p._o")
    if limit is None:
        return once.drop("_o")
    # of equal times the better score comes first, then the one seen first
    rank = F.row_number().over(W.partitionBy(by).orderBy("kind", "t_start", "t_end", F.col("score").desc(), "_o"))
    return once.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r", "_o")


def timeline(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """Tagged union of scenes and frames, to be ordered by time."""
    s = scenes.withColumn("entry", F.lit("scene")).withColumn("at", F.col("start"))
    f = frames.withColumn("entry", F.lit("frame")).withColumn("at", F.col("ts"))
    return s.unionByName(f, allowMissingColumns=True)


def latest(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last written row of each key."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def last_write(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Each column's last non-null value by write order."""
    return df.groupBy(key).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def union_merge(df: DataFrame, key: str, value: str) -> DataFrame:
    """The safe alternative to ``last_write`` for evidence: the sorted set of all writers' values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(value))


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: str, keep_first: str) -> DataFrame:
    """Insert or update: the latest row of a key wins, ``keep_first`` stays that of the earliest."""
    both = table.unionByName(updates)
    others = [c for c in table.columns if c not in (*keys, keep_first, order)]
    return both.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in others], F.max(order).alias(order), F.min(keep_first).alias(keep_first))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table, key, "left_anti").select(*table.columns))


def shard(df: DataFrame, order: str, n: int, m: int) -> DataFrame:
    """Rows whose position by ``order`` is ``n`` modulo ``m``, numbered without one global window.

    Range partitions are numbered by their counts (one number a partition) plus a local position.
    """
    if not 0 <= n < m:
        n, m = 0, 1
    dealt = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    local = dealt.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1)
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_p").where((F.col("_b") + F.col("_i")) % m == n).drop("_p", "_i", "_b")
