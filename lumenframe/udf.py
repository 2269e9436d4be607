"""Model backends: an interface for captioning, answering, speech, slide text, encoders and judging.

No weights are shipped. The stubs are deterministic, so pipelines can be tested.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import give_back, ship, slices

Backend = Callable[[str], str]
#: Bytes and rows of texts that a worker holds as objects at once.
PIECE, ROWS = 1 << 20, 1024


def stub_caption(image: str) -> str:
    return f"caption {hashlib.sha1(image.encode()).hexdigest()[:8]}"


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """A hashed bag of words, L2-normalized: stands in for a dense encoder."""
    v = np.zeros(size)
    for w in text.lower().split():
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % size] += 1.0 if h & 1 << 31 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def stub_pixels(name: str, side: tuple[int, int] = (9, 8)) -> np.ndarray:
    """Grey levels that stand in for a decoded picture."""
    seed = int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
    return np.random.default_rng(seed).integers(0, 256, (side[1], side[0]))


def difference_hash(grey: np.ndarray) -> int:
    """64 bits: whether each of 8 by 9 grey levels is below its right neighbour, the first bit highest; signed."""
    bits = (grey[:, :-1] < grey[:, 1:]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def stub_segments(path: str) -> list[dict]:
    """Speech of a file: a segment of 0.1 s is among them, as recognizers give."""
    n = int(hashlib.md5(path.encode()).hexdigest()[:2], 16) % 4 + 1
    return [{"t_start": 3.0 * i, "t_end": 3.0 * i + 2.5, "text": f"segment {i} of {path}"} for i in range(n)] + [{"t_start": 0.0, "t_end": 0.1, "text": "uh"}]


def stub_probe(path: str) -> dict:
    h = int(hashlib.md5(path.encode()).hexdigest()[:4], 16)
    if path.endswith(".broken"):
        raise OSError("moov atom not found")
    return {"fps": 25.0, "frames": 25 * (h % 600 + 1), "width": 640, "height": 360}


def stub_judge(text: str) -> str:
    same = len(set(text.lower().split())) % 2 == 0
    return f'{{"correct": {str(same).lower()}, "score": {5 if same else 1}, "justification": "stub"}}'


class Retry:
    """Calls a backend again after temporary failures, after waits that double."""

    def __init__(self, backend: Backend, tries: int = 6, wait: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep):
        self.backend, self.tries, self.wait, self.longest, self.sleep = backend, tries, wait, longest, sleep

    def __call__(self, x: str) -> str:
        for i in range(self.tries):
            try:
                return self.backend(x)
            except (OSError, TimeoutError) as e:
                if i + 1 == self.tries:
                    raise
                self.sleep(min(self.longest, getattr(e, "retry_after", None) or self.wait * 2**i))
        raise AssertionError


def degrade(frames: list, side: int, call: Callable[[list, int], str], times: int = 3) -> str:
    """Asks with half the frames and three quarters of the side, up to ``times``, while the prompt is too long."""
    for i in range(times + 1):
        try:
            return call(frames, side)
        except ValueError as e:
            if "too long" not in str(e) or i == times:
                raise
            frames, side = frames[:: 2] if len(frames) > 1 else frames, int(side * 0.75)
    raise AssertionError


def _in_pieces(df: DataFrame, column: str, out: str, kind: str, made: Callable[[list], pa.Array]) -> DataFrame:
    """``out`` of type ``kind`` from ``made``, which gets about ``PIECE`` bytes of texts at once: a worker never holds a batch as objects."""
    ship(df.sparkSession)

    @F.arrow_udf(kind)
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            sizes = np.maximum(pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False), PIECE // ROWS)
            yield pa.concat_arrays([made(b.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(sizes, PIECE)] or [made([])])
        give_back()

    return df.withColumn(out, call(F.col(column).cast("string")))


def map_text(df: DataFrame, column: str, out: str, backend: Backend = stub_caption, retries: int = 1, group: int = 8) -> DataFrame:
    """Model calls in groups of ``group`` at once; an empty reply is asked for once more. Nulls stay."""

    def one(x):
        if x is None:
            return None
        reply = backend(x)
        for _ in range(retries):
            reply = reply or backend(x)
        return reply

    def replies(texts):
        with ThreadPoolExecutor(group) as pool:
            return pa.array(pool.map(one, texts), pa.string())

    return _in_pieces(df, column, out, "string", replies)


def encode_text(df: DataFrame, column: str, out: str, encoder: Callable[[str], list[float]] = hashed_vector) -> DataFrame:
    return _in_pieces(df, column, out, "array<double>", lambda texts: pa.array([encoder(x or "") for x in texts], pa.list_(pa.float64())))


#: Encodes pictures as ``encode_text`` does texts: a backend gets their names.
encode_images = encode_text


def picture_hashes(df: DataFrame, column: str, out: str, decode: Callable[[str], np.ndarray] = stub_pixels) -> DataFrame:
    """Difference hashes of pictures."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def call(s: pd.Series) -> pd.Series:
        return pd.Series([difference_hash(decode(x)) for x in s], index=s.index, dtype="int64")

    return df.withColumn(out, call(F.col(column)))


def transcribe(df: DataFrame, column: str, backend: Callable[[str], list[dict]] = stub_segments, least: float = 0.2) -> DataFrame:
    """A row for every speech segment of ``least`` seconds or more: ``t_start``, ``t_end``, ``text``."""
    kind = "array<struct<t_start: double, t_end: double, text: string>>"
    made = map_text(df, column, "_json", lambda x: json.dumps(backend(x)))
    made = made.withColumn("s", F.explode(F.from_json("_json", kind))).select(*df.columns, "s.*")
    return made.where(F.col("t_end") - F.col("t_start") >= least)


def slide_texts(df: DataFrame, column: str, backend: Callable[[str], list]) -> DataFrame:
    """Rows whose picture holds text, with ``text``; ``backend`` gives ``[box, text, score]`` rows."""
    from .functions.parsing import ocr_blocks, ocr_text

    made = map_text(df, column, "_json", lambda x: json.dumps(backend(x)))
    return made.withColumn("text", ocr_text(ocr_blocks("_json"))).where("text <> ''").drop("_json")


def probe(df: DataFrame, column: str, backend: Callable[[str], dict] = stub_probe, repair: Callable[[str], str] | None = None, duration: Callable[[str], float] | None = None) -> DataFrame:
    """``fps``, ``frames``, ``width``, ``height``, ``duration`` and ``error`` of containers.

    A container that can't be opened is repaired and opened again; where that fails too, its duration alone is asked for.
    """

    def one(path: str) -> str:
        try:
            try:
                found = backend(path)
            except OSError:
                if repair is None:
                    raise
                found = backend(repair(path))
            return json.dumps(found | {"duration": found["frames"] / found["fps"]})
        except OSError as e:
            return json.dumps({"duration": duration(path) if duration else None, "error": str(e)})

    made = map_text(df, column, "_json", one, 0)
    return made.withColumn("p", F.from_json("_json", "fps double, frames long, width int, height int, duration double, error string")).select(*df.columns, "p.*")


def judge(df: DataFrame, prompt: str, out: str = "judge", backend: Backend = stub_judge) -> DataFrame:
    """A judge's verdict ``struct<correct, score, justification, error>`` on every prompt."""
    from .plans.evaluation import judge_json

    return map_text(df, prompt, "_reply", backend).withColumn(out, judge_json(F.col("_reply"))).drop("_reply")


def read_through(rows: DataFrame, cache: DataFrame, key: str, column: str, out: str, backend: Backend) -> DataFrame:
    """Cached replies where known; the backend answers the rest."""
    hits = rows.join(cache.withColumnRenamed("value", out), key)
    return hits.unionByName(map_text(rows.join(cache, key, "left_anti"), column, out, backend))


def judge_cached(df: DataFrame, key: str, prompt: str, path: str, out: str = "judge", backend: Backend = stub_judge) -> DataFrame:
    """``judge`` through a cache in ``path``: known verdicts are read, new ones that are no errors are appended."""
    from .plans.evaluation import judge_json
    from .runtime import stored
    from .sources.files import append_cache, exists, read_cache

    spark = df.sparkSession
    known = read_cache(spark, path) if exists(spark, path) else spark.createDataFrame([], "key string, value string")
    rows = df.withColumn("_key", F.col(key).cast("string")).join(known.select(F.col("key").alias("_key"), F.col("value").alias("_known")), "_key", "left")
    fresh = stored(map_text(rows.where("_known is null"), prompt, "_reply", backend).withColumn(out, judge_json(F.col("_reply"))), "judged")
    good = fresh.where(F.col(out)["error"].isNull() & F.col("_reply").isNotNull())
    append_cache(good.select(F.col("_key").alias("key"), F.col("_reply").alias("value"), F.lit(time.time_ns()).alias("seq")).dropDuplicates(["key"]), path)
    old = rows.where("_known is not null").withColumn(out, judge_json(F.col("_known")))
    columns = [*df.columns, out]
    return fresh.select(*columns).unionByName(old.select(*columns))
