"""Registered queries: name, function of (spark, sf_dir), equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_even(spark, sf_dir: str, name: str) -> DataFrame:
    """The same for work that texts make dear: a table of fewer splits than cores is dealt over them."""
    df, cores = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
