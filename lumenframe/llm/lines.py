"""Removal of lines that many documents share, through a sharded minimal perfect hash.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``MIN_CHARS``
code points that at least ``LEAST`` documents hold lose their lines everywhere but in the document
with the largest id that holds them.

Index: every distinct key is 128 bits of hash, 64 that place it and 64 that prove it. Its documents are
counted in Spark; keys below ``LEAST`` can't drop anything, so the index leaves them out. The rest is dealt
into shards of about ``SHARD`` keys; a task builds each shard: bit arrays in which a key's first
undisturbed place, level by level, is its own, and the rank of that bit is its slot in arrays of
fingerprints, counts and last ids. That is 3 to 4 bits a key for placing and 24 bytes of values.
A line that isn't in the index meets a slot with its very fingerprint once in 2^64 probes.

Probe: documents are read once more, and their lines' hashes, not their texts, pass through Python.
A task gathers about ``LINES`` hashes, sorts them by shard and reads the shards one after another from
the shared folder, so it holds one shard at a time whatever the size of the index. No line is joined
and no text is shuffled. Reading costs one pass of the index a gathering; a larger ``LINES`` lowers it.

Defined cases: a null or empty text is one empty line; rows that repeat an id are one document when they
are counted, and each is cleaned; rows without an id are one further document, never the last; a line
repeated in the last document stays each time. An empty table gives an empty index and result. Columns
that aren't named are kept by ``clean`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import free_name, fresh_path, give_back, require, table, written

LEAST, MIN_CHARS = 3, 20
#: Keys a shard has on average: about 4 MB, which bounds what a task builds or holds.
SHARD = 1 << 17
#: Line hashes that a task gathers before it reads the index.
LINES = 1 << 20
#: Bits a level has for each key that is still without a place.
LOAD = 2
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "shard int, sizes binary, bits binary, fingerprints binary, counts binary, lasts binary"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The key of every line, in order."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(BLANKS)))


def hashes_of(text: Column, min_chars: int) -> Column:
    """``(a, b)`` of every line, both 0 for one whose key is too short to count."""
    long_ = lambda k: F.char_length(k) >= min_chars
    zero = F.lit(0).cast("long")
    return F.transform(keys_of(text), lambda k: F.struct(F.when(long_(k), F.xxhash64(k)).otherwise(zero).alias("a"), F.when(long_(k), F.xxhash64(F.lit(1), k)).otherwise(zero).alias("b")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
    return (_mix(a.view(np.uint64) + step) ^ _mix(b.view(np.uint64) ^ step)) % np.uint64(size)


class PerfectHash:
    """Slots 0 to n-1 for n distinct pairs of longs."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits: one boolean a place, level after level
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(a):
            size = LOAD * len(a) + 1
            at = _places(a, b, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            placed = alone[at.astype(np.int64)]
            sizes.append(size)
            levels.append(alone)
            a, b = a[~placed], b[~placed]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; any slot or -1 for a pair that wasn't built in."""
        out, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _places(a[left], b[left], level, size).astype(np.int64) + start
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + size
        return out


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)
    hashed = PerfectHash.build(a, b)
    slot = hashed.slots(a, b)
    arrays = []
    for c in (b, rows["n"].to_numpy(np.int64), rows["last"].to_numpy(np.int64)):
        out = np.empty(len(a), np.int64)
        out[slot] = c
        arrays.append(out.tobytes())
    return pd.DataFrame([(int(rows["shard"].iloc[0]), hashed.sizes.tobytes(), np.packbits(hashed.bits).tobytes(), *arrays)], columns=[c.split()[0] for c in _INDEX.split(", ")])


@dataclass(frozen=True)
class Shard:
    hashed: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    lasts: np.ndarray

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(count, last)`` of each line, a count of 0 for one that isn't indexed."""
        slot = self.hashed.slots(a, b)
        there = slot >= 0
        there[there] = self.fingerprints[slot[there]] == b[there]
        count, last = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        count[there], last[there] = self.counts[slot[there]], self.lasts[slot[there]]
        return count, last


def _shards(path: str) -> Iterator[tuple[int, Shard]]:
    """The shards of a written index, one in memory at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as src:
                for batch in pq.ParquetFile(src).iter_batches(batch_size=1):
                    for r in batch.to_pylist():
                        sizes = np.frombuffer(r["sizes"], np.int64)
                        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
                        yield r["shard"], Shard(PerfectHash(sizes, bits), *[np.frombuffer(r[c], np.int64) for c in ("fingerprints", "counts", "lasts")])


@dataclass(frozen=True)
class LineIndex:
    """A written index: its folder, number of shards, and what its keys went through."""

    path: str
    shards: int
    keys: int
    least: int
    min_chars: int


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(a, b, n, last)`` of every distinct key: the documents that hold it and the largest id of these."""
    key = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.filter(hashes_of(F.col(text_col), min_chars), lambda h: (h["a"] != 0) | (h["b"] != 0))).alias("h"))
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return key.groupBy("h.a", "h.b").agg(n.alias("n"), F.max("id").alias("last"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_chars: int = MIN_CHARS) -> LineIndex:
    """Build the index of all keys that at least ``least`` documents hold (two at least, so that one of them has an id)."""
    require(docs, id_col, text_col)
    if least < 2 or min_chars < 1:
        raise ValueError("least must be 2 or more, min_chars 1 or more")
    spark = docs.sparkSession
    ship(spark)
    keys = written(counted(docs, id_col, text_col, min_chars).where(F.col("n") >= least), "line-keys")
    n = keys.count()
    shards = max(1, -(-n // SHARD))
    path = fresh_path(spark, "line-index")
    dealt = keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    dealt.groupBy("shard").applyInPandas(_build_shard, _INDEX).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return LineIndex(path, shards, n, least, min_chars)


def _probe(found: LineIndex, least: int):
    """An Arrow function from ids and line hashes to one flag a line: whether it stays."""

    def keep(ids: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        some = np.flatnonzero((a != 0) | (b != 0))
        shard = a[some] % found.shards  # numpy's remainder has the divisor's sign, as pmod has
        some = some[np.argsort(shard, kind="stable")]
        shard = np.sort(shard)
        for k, s in _shards(found.path):
            lo, hi = np.searchsorted(shard, [k, k + 1])
            if lo < hi:
                at = some[lo:hi]
                count, last = s.find(a[at], b[at])
                out[at] = (count < least) | known[at] & (last == ids[at])
        return out

    def flush(held: list[tuple]) -> Iterator[pa.Array]:
        lens = [np.diff(o) for *_, o in held]
        ids = np.concatenate([np.repeat(i, n) for (i, *_), n in zip(held, lens, strict=True)])
        known = np.concatenate([np.repeat(k, n) for (_, k, *_), n in zip(held, lens, strict=True)])
        flags = keep(ids, known, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
        at = 0
        for *_, o in held:
            yield pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(flags[at : at + int(o[-1] - o[0])]))
            at += int(o[-1] - o[0])

    @F.arrow_udf("array<boolean>")
    def stays(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held, n = [], 0
        for ids, hashes in batches:
            if isinstance(hashes, pa.ChunkedArray):
                ids, hashes = ids.combine_chunks(), hashes.combine_chunks()
            offsets, flat = hashes.offsets.to_numpy(), hashes.flatten()
            a, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), a, b, offsets))
            n += len(a)
            if n >= LINES:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)
        give_back()

    return stays


def cleaned(docs: DataFrame, found: LineIndex, out: str = "kept", id_col: str = "doc_id", text_col: str = "text", least: int | None = None) -> DataFrame:
    """All columns of ``docs``, ``out`` with the text that stays, and ``<out>_lines`` and ``<out>_dropped`` with counts of lines.

    ``least`` may be larger than that of the index, never smaller.
    """
    require(docs, id_col, text_col)
    if least is not None and least < found.least:
        raise ValueError("the index lacks keys of so few documents")
    flags = free_name("_stays", docs.columns)
    stays = _probe(found, least or found.least)(F.col(id_col).cast("long"), hashes_of(F.col(text_col), found.min_chars))
    rows = docs.withColumn(flags, stays)
    kept = F.filter(lines_of(F.col(text_col)), lambda _, i: F.get(F.col(flags), i))
    lost = F.size(F.filter(F.col(flags), lambda x: ~x))
    return rows.withColumns({out: F.array_join(kept, "\n"), f"{out}_lines": F.size(flags).cast("long"), f"{out}_dropped": lost.cast("long")}).drop(flags)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text."""
    out = free_name("_kept", [c for name in docs.columns for c in (name, name.removesuffix("_lines").removesuffix("_dropped"))])
    rows = cleaned(docs, index(docs, id_col, text_col, least, min_chars), out, id_col, text_col)
    return rows.select(*[F.col(out).alias(c) if c == text_col else c for c in docs.columns])


def op12_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cleaned(docs, index(docs))
    return rows.select("doc_id", F.col("kept_lines").alias("n_lines"), F.col("kept_dropped").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
n AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {LEAST}),
f AS (SELECT r, k.doc_id, line, i, last IS NULL OR last IS NOT DISTINCT FROM k.doc_id AS stays FROM k LEFT JOIN n USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM f GROUP BY r
"""
