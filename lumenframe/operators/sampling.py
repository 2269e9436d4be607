"""Stratified allocation and per-group samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def initial_shares(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """``(stratum, size, share)``: proportional shares, half-even, one at least."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    share = F.greatest(F.lit(1), F.bround(F.col("size") / F.col("total") * n).cast("long"))
    return sizes.crossJoin(F.broadcast(total)).select(stratum, "size", F.when(F.col("total") <= n, F.col("size")).otherwise(share).alias("share"))


def repair(shares: list[tuple[str, int, int]], n: int) -> dict[str, int]:
    """Shares adjusted to sum to ``n``: one off the largest share/size, or one onto the smallest, first stratum on ties."""
    size, share = {s: z for s, z, _ in shares}, {s: a for s, _, a in shares}
    if sum(size.values()) <= n:
        return size
    while sum(share.values()) > n:
        s = max(share, key=lambda x: share[x] / size[x])
        if share[s] <= 1:
            break
        share[s] -= 1
    while sum(share.values()) < n:
        s = min(share, key=lambda x: share[x] / size[x])
        if share[s] >= size[s]:
            break
        share[s] += 1
    return share


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """About ``n`` rows by allocation; members by hash order. The strata are few, so their shares are repaired here."""
    shares = repair([tuple(r) for r in initial_shares(df, stratum, n).orderBy(stratum).collect()], n)
    order = W.partitionBy(stratum).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    limit = F.lit(0)
    for s, k in shares.items():
        limit = F.when(F.col(stratum).eqNullSafe(F.lit(s)), k).otherwise(limit)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group by ``order``; group limits apply before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col).limit(n)


def allocate(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """``(stratum, size, share)`` by largest remainders, in the plan alone: no share is looped over in the driver.

    Every stratum gets the whole part of its quota, one at least and its size at most; places left go to those that have room,
    the largest remainder first, then by name. With more strata than places each has one, which is more than ``n`` in all.
    The second ranking is over one row a stratum.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    everything = W.partitionBy(F.lit(0))
    quota = F.lit(float(n)) * F.col("size") / F.sum("size").over(everything)
    base = F.least(F.col("size"), F.greatest(F.lit(1), F.floor("quota")))
    rows = sizes.withColumn("quota", quota).withColumn("base", base.cast("long"))
    rows = rows.withColumn("rest", F.greatest(F.lit(0), F.lit(n) - F.sum("base").over(everything)))
    place = F.row_number().over(everything.orderBy((F.col("base") >= F.col("size")).cast("int"), (F.col("quota") - F.col("base")).desc(), stratum))
    more = ((F.col("place") <= F.col("rest")) & (F.col("base") < F.col("size"))).cast("long")
    return rows.withColumn("place", place).select(stratum, "size", (F.col("base") + more).alias("share"))


def allocated_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """The rows that ``allocate`` gives each stratum, in hash order; planned as a whole, without a collect."""
    order = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col)
    ranked = df.withColumn("_r", F.row_number().over(order))
    return ranked.join(allocate(df, stratum, n).select(stratum, "share"), stratum).where(F.col("_r") <= F.col("share")).drop("_r", "share")
