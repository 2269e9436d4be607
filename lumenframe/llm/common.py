"""Shared helpers: the cluster's shared folder, written tables, joins on hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import give_back, map_arrow, slices  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master gets a folder of its own;
    any other master raises, since a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints/lumenframe"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The written files outlive any executor, so later stages never redo the work.
    They go when the session ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    back = spark.read.schema(df.schema).parquet(path)
    back.folder = folder  # for discard
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once no later step reads it."""
    df.folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df.folder, True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if it holds over one in ``HOT_SHARE`` of all rows, or over ``MOST_ROWS`` of them.
HOT_SHARE, LEAST_ROWS, MOST_ROWS = 1000, 64, 1_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str | None, counts: DataFrame, strategy: str | None = None, how: str = "inner") -> DataFrame:
    """Equi-join (inner or left) of many rows with one row a key, where a key may hold a large share of ``left``.

    ``counts`` has ``on`` and ``n``, the rows of each key. A hot key's rows are dealt into groups of about the
    size that makes a key hot, and the key's one row on the right is copied to each group. Only the hot keys
    are broadcast: there are fewer than ``HOT_SHARE``, or one in ``MOST_ROWS`` rows. Null keys match nothing.
    Rows are dealt by the hash of ``by``; None deals them in turn, for a ``left`` read from files, whose order is fixed.
    ``strategy`` is a join hint for the narrow right side: ``shuffle_hash`` spares a sort of wide rows.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(min(total / HOT_SHARE, MOST_ROWS), LEAST_ROWS)
    hot = F.broadcast(counts.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).alias("_groups")))
    turn = F.monotonically_increasing_id() if by is None else F.xxhash64(by)
    salt = F.when(F.col("_groups").isNotNull(), F.pmod(turn, F.col("_groups"))).otherwise(0).cast("int")
    many = left.join(hot, on, "left").withColumn("_salt", salt).drop("_groups")
    copies = F.sequence(F.lit(0), (F.coalesce("_groups", F.lit(1)) - 1).cast("int"))
    one = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_groups")
    return many.join(one.hint(strategy) if strategy else one, [*on, "_salt"], how).drop("_salt")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
