"""Media columns: content-addressed payloads in tar shards, read back by byte range.

A text's UTF-8 bytes are padded with spaces to a positive multiple of 192 and
stored losslessly as an 8-bit greyscale PNG, 192 samples wide. Payloads are
addressed by their SHA-256; rows carry digest, shard, offset and length. A
header-only range read (33 bytes) fills the metadata columns; the payload itself
is read only where a column needs it.

Plan: (1) one Arrow pass writes the tar shards of each task in the shared
folder, each payload once a task, and returns index rows, which are written as
Parquet: that table is the commit, so shards of failed attempts are never
referenced. (2) The least (shard, offset) of a digest is its address for all
rows; a narrow aggregation finds it. (3) Members are dealt by shard and range and
read in order. (4) Index rows join their member's columns by digest, a digest of
many rows over many tasks; payloads are never shuffled.

Null and empty text are 192 spaces with ``n_bytes`` 0. Equal payloads share one
address. Rows with null or repeated ids come out as they went in.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, spread_join, table, written

WIDTH = 192
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
MOST_TASKS = 100_000
#: Digests that a task remembers, so that it stores a payload once; it starts anew beyond that.
SEEN = 1 << 19
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return raw.ljust(size, b" "), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    scan = np.zeros((len(rows), width + 1), np.uint8)  # filter type 0 before each line
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first 33 bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(stored: bytes) -> bytes:
    width, height, bits = read_header(stored[:HEADER_BYTES])
    at, parts = 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    scan = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * bits // 8 + 1)
    if scan[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return scan[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 64-bit average hash over 64 equal stretches of the samples."""
    a = np.frombuffer(samples, np.uint8)
    cuts = np.arange(64) * len(a) // 64
    means = np.add.reduceat(a, cuts, dtype=np.int64) / np.diff(np.r_[cuts, len(a)])
    bits = int(np.packbits(means > a.mean()).view(">u8")[0])
    return f"{a.mean():.4f};{a.std():.4f};{bits:016x}"


INDEX = "id long, n_bytes long, digest string, shard string, offset long, length long"
MEMBER = "digest string, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long, n long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Tar shards of one task attempt."""

    def __init__(self, root: str, tag: str, most: int):
        self.fs, self.base = filesystem(root)
        self.fs.create_dir(self.base)
        self.tag, self.most, self.count, self.out = tag, most, 0, None

    def put(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(data) > self.most and self.at:
            self.close()
            self.name = f"{self.tag}-{self.count:04d}.tar"
            self.out, self.at, self.count = self.fs.open_output_stream(f"{self.base}/{self.name}"), 0, self.count + 1
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        found = (self.name, self.at + len(head), len(data))
        self.at += len(head) + len(data) + -len(data) % 512
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads below ``root``; the index of all rows, as a written table."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shards = ShardWriter(root, f"{task.partitionId():06d}-{task.taskAttemptId()}", shard_bytes)
        seen: dict[str, tuple[str, int, int]] = {}
        try:
            for b in batches:
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data, n = payload(t.as_py())
                    digest = hashlib.sha256(data).hexdigest()
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[digest] = shards.put(f"{digest}.png", encode_png(data))
                    rows.append((i, n, digest, *seen[digest]))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            shards.close()

    return written(map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, INDEX), "media-index")


def members(index: DataFrame) -> DataFrame:
    """One row per digest: its least address and its rows ``n``."""
    least = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a"), F.count(F.lit(1)).alias("n"))
    return least.select("digest", "a.*", "n")


def read_members(addresses: DataFrame, root: str, header_only: bool = False) -> DataFrame:
    """Metadata columns by header ranges and the address; unless ``header_only``, the payload's own columns too."""

    def run(batches):
        fs, base = filesystem(root)
        name, src = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    if src is not None:
                        src.close()
                    name, src = shard, fs.open_input_file(f"{base}/{shard}")
                head = src.read_at(HEADER_BYTES, offset)
                row = [digest, *read_header(head)]
                if header_only:
                    row += [None] * 6
                else:
                    stored = head + src.read_at(length - HEADER_BYTES, offset + HEADER_BYTES)
                    data = decode_png(stored)
                    row += [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), length, hashlib.sha256(stored).hexdigest(), feature(data)]
                rows.append([*row, shard, offset, length, n])
            cols = list(zip(*rows, strict=True)) or [[]] * 14
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in MEMBER.split(", ")])

    ranges = F.floor(F.col("offset") / RANGE_BYTES)
    # as many tasks as the media need: the index rows that are dealt say nothing of their size
    total = addresses.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // RANGE_BYTES), MOST_TASKS))
    dealt = addresses.select("digest", "shard", "offset", "length", "n").repartition(tasks, "shard", ranges).sortWithinPartitions("shard", "offset")
    return map_arrow(dealt, run, MEMBER)


def media_columns(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's address, metadata and read-back columns."""
    root = root or fresh_path(docs.sparkSession, "media")
    index = store(docs, root, id_col, text_col)
    found = written(read_members(members(index), root), "media-members")
    return spread_join(index.select("id", "n_bytes", "digest"), found.drop("n"), ["digest"], None, found.select("digest", "n"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"))
    cols = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "shard", "offset", "length"]
    return found.select(F.col("id").alias("doc_id"), *cols)
