"""Shard placement by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own,
``(offset + j * skip) mod size``. Shards take turns, each claiming its next free
slot, until the table is full, so shares differ by one slot at most and adding or
removing a shard moves few keys. A key's slot is a hash modulo the size, and a
broadcast of the table gives its shard in constant time.

Plan: DataFrame functions only, one pass over the keys, no shuffle. The table is
the one broadcast; its size is a parameter below ``LARGEST`` slots (about 16 MB)
and doesn't depend on the input. A source that holds a third of the rows spreads
evenly, as keys are row ids.

A null key is placed as the empty string. Equal keys share a shard. An empty
input gives an empty result; no shards is an error. Input columns named ``slot``
or ``shard`` are replaced by the placement; the key may be one of them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
LARGEST = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=16)
def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> tuple[int, ...]:
    """The shard's position in ``shards`` for every slot."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if size > LARGEST or not is_prime(size):
        raise ValueError(f"the table size must be a prime below {LARGEST}")
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    at = [_number(f"offset:{s}") % size for s in shards]
    out, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            out[at[i]] = i
            left -= 1
            if not left:
                return tuple(out)


def slot_of(key, size: int = SIZE) -> F.Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def table_frame(spark, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """``(slot, shard)`` rows, made in the JVM from one literal."""
    listed = ",".join(map(str, lookup_table(shards, size)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard_no"))
    names = F.array(*[F.lit(s) for s in shards])
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("shard_no").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key_col: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """All columns of ``df`` plus ``slot`` and ``shard``."""
    lookup = table_frame(df.sparkSession, tuple(shards), size)
    key = free_name("slot", df.columns)
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.withColumn(key, slot_of(F.col(key_col), size)).select(*kept, F.col(key).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")


def op7_sharding(spark, sf_dir) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def oracle() -> str:
    listed = ",".join(map(str, lookup_table()))
    return f"""
WITH t AS (SELECT string_split('{listed}', ',') AS a),
k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SIZE} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(a[slot + 1], 3, '0') AS shard FROM k, t
"""
