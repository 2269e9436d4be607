"""An inverted file over vectors: cells around centroids, one partition a cell, probed by cell and ranked exactly.

``fit`` runs spherical k-means in Spark: a task assigns its vectors to the broadcast centroids and sends one sum a
cell, so an iteration moves cells, not vectors. Centroids are the only thing that the driver holds: their number is a
parameter below ``MOST_CELLS``. Every vector is indexed, in the cell of its nearest centroid; a cell of any size is
dealt over files. A search names its cells before it plans, so other partitions are never listed; with ``probes``
of None it takes all cells, which is exact. Vectors that are null, empty, of another width or hold NaN score 0 and lie in some cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..runtime import ship
from .nearest import best_in_pieces

#: On vectors without clusters 12 of 16 cells hold nine in ten of the nearest twenty; clustered ones need far fewer.
MOST_CELLS, ROUNDS, PROBES, SPREAD = 4096, 6, 12, 8
#: Names a stored row.
ROW = "_row"


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length; null, empty and zero vectors, and those of another width, are zeros."""
    out = np.zeros((len(column), width))
    lens = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (lens == width)
    out[ok] = np.nan_to_num(flat[starts[ok][:, None] + np.arange(width)])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


class VectorIndex:
    """``centroids`` (cells x width, rows of unit length) and the folder ``path`` with a partition ``cell=<n>`` for each."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, vector: str = "embedding"):
        self.spark, self.path, self.centroids, self.vector = spark, path, centroids, vector

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int, key: str, vector: str = "embedding", rounds: int = ROUNDS) -> VectorIndex:
        """Fit the cells and write all rows of ``vectors``."""
        index = cls(vectors.sparkSession, path, fit(vectors, cells, key, vector, rounds), vector)
        dealt = index.assigned(vectors).repartition(F.col("cell"), F.pmod(F.xxhash64(key), F.lit(SPREAD)))
        dealt.withColumn(ROW, F.monotonically_increasing_id()).write.partitionBy("cell").parquet(path)
        return index

    def assigned(self, vectors: DataFrame) -> DataFrame:
        return vectors.withColumn("cell", _nearest(self.centroids, 1)(F.col(self.vector))[0])

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        found = self._stored().drop(ROW)
        return found if cells is None else found.where(F.col("cell").isin(*cells))

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, query: list[float], k: int, tie: str, probes: int | None = PROBES) -> DataFrame:
        """The ``k`` nearest rows by cosine among the ``probes`` nearest cells, or among all."""
        cells = None
        if probes is not None:
            near = self.centroids @ np.asarray(query, float)
            cells = np.argsort(-near, kind="stable")[:probes].tolist()
        q = F.array(*[F.lit(float(x)) for x in query])
        return self.rows(cells).withColumn("score", F.nanvl(cosine(self.vector, q), F.lit(0.0))).orderBy(F.col("score").desc(), tie).limit(k)

    def search_many(self, questions: DataFrame, k: int, by: str, tie: str, query: str = "query", probes: int | None = PROBES) -> DataFrame:
        """``(by, rows..., score, rank)`` for a table of questions: each meets the rows of its cells only.

        Blocks of questions meet pieces of cells (``nearest``), and only row numbers and scores move on; the rows of the best come last.
        """
        n = len(self.centroids)
        near = _nearest(self.centroids, n if probes is None else min(probes, n))(F.col(query))
        asked = questions.select(F.col(by).alias("_by"), F.col(query).alias("_query"), F.explode(near).alias("cell"), F.lit(k).alias("_k"))
        held = self._stored()
        scored = best_in_pieces(asked, held.withColumn("_tie", F.col(tie)), "cell", "_by", "_query", "_k", self.vector, ["_tie"], (ROW,))
        rank = F.row_number().over(W.partitionBy("_by").orderBy(F.col("score").desc(), "_tie"))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("_tie")
        return best.join(held.drop("cell"), ROW).select(F.col("_by").alias(by), *[c for c in held.columns if c not in ("cell", ROW)], "score", "rank")


def _nearest(centroids: np.ndarray, n: int):
    """The ``n`` nearest cells of a vector, the best first; cell 0 for what is no vector."""

    @F.arrow_udf("array<int>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            b = b.combine_chunks() if isinstance(b, pa.ChunkedArray) else b
            cells = np.argsort(-(_unit(b, centroids.shape[1]) @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * n), pa.array(cells.ravel()))

    return near


def fit(vectors: DataFrame, cells: int, key: str, vector: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of at most ``cells`` cells; the first ones are vectors in the order of their hashed keys."""
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must lie between 1 and {MOST_CELLS}")
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("k")).where(F.size("v") > 0)
    first = [r["v"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(cells).collect()]
    first = np.array([v for v in first if len(v) == len(first[0])], float)
    if not len(first):
        return np.zeros((1, 1))
    width = first.shape[1]
    centers = np.nan_to_num(first) / np.maximum(np.linalg.norm(np.nan_to_num(first), axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], held=centers) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(held), np.zeros(len(held), np.int64)
            for b in batches:
                x = _unit(b.column(0), width)
                cell = (x @ held.T).argmax(axis=1)
                np.add.at(total, cell, x)
                count += np.bincount(cell, minlength=len(held))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["cell", "total"])

        parts = rows.select("v").mapInArrow(sums, "cell int, total array<double>")
        moved = parts.select("cell", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        moved = moved.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("total"))
        centers = centers.copy()
        for r in moved.collect():  # one row a cell
            norm = np.linalg.norm(r["total"])
            if norm > 0:
                centers[r["cell"]] = np.asarray(r["total"]) / norm
    return centers
