"""The nearest vectors of many questions, block against block.

Rows and questions that share a key (a cell, a video) are dealt into pieces and blocks of about ``PIECE`` each, and a group is one
piece with one block, so a task's memory doesn't grow with the tables, and what leaves it is a question's best rows. Pairs are
compared by matrix products; scores that come near a question's best are then added up in the order of the components, so
equal vectors have equal scores wherever they lie and scores are those of ``numeric.cosine``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

#: Rows a side of a group; questions that are scored at a time; by how much a product may miss the exact score.
PIECE, TILE, MARGIN = 16384, 128, 1e-9


def best_in_pieces(questions: DataFrame, rows: DataFrame, on: str, by: str, query: str, most: str, vector: str, ties: list[str], keep: tuple[str, ...] = (), once: bool = False, odd: float = 0.0) -> DataFrame:
    """``(by, ties..., keep..., score)``: of every piece each question's best ``most`` rows by cosine, then ``ties``.

    The best of all pieces are among them. With ``once`` a value of ``ties`` counts once in a piece, by its best score. Vectors
    that are null or of another width than the question score 0, those that aren't finite score ``odd``, where NaN is above all.
    """
    ship(rows.sparkSession)
    parts = lambda df, name: df.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias(name))
    sizes = parts(rows, "_pieces").join(parts(questions, "_blocks"), on)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    held = rows.join(sizes, on).select(F.col(on).alias("_on"), dealt("_pieces", *ties, vector).alias("_piece"), each("_blocks").alias("_block"), F.col(vector).alias("_v"), *ties, *keep)
    asked = questions.join(sizes, on).select(F.col(on).alias("_on"), each("_pieces").alias("_piece"), dealt("_blocks", by).alias("_block"), F.col(by).alias("_by"), F.col(query).alias("_q"), F.col(most).cast("int").alias("_most"))
    group = ["_on", "_piece", "_block"]
    schema = T.StructType([T.StructField(by, questions.schema[by].dataType), *[T.StructField(c, rows.schema[c].dataType) for c in (*ties, *keep)], T.StructField("score", T.DoubleType())])

    def cut(r: pa.Table, q: pa.Table) -> pa.Table:
        r = r.take(pc.sort_indices(r, sort_keys=[(t, "ascending") for t in ties], null_placement="at_start"))
        at, row, score = _best(r, q, ties, once, odd)
        found = [q["_by"].take(at), *[r[c].take(row) for c in (*ties, *keep)], score]
        return pa.table(found, names=[by, *ties, *keep, "score"])

    return held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(cut, schema)


def _widths(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Widths (-1 for null), starts and flat values of vectors."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    offsets = a.offsets.to_numpy()
    return np.where(a.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1), offsets[:-1], a.values.to_numpy(zero_copy_only=False).astype(np.float64)


def _matrix(vectors: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as columns, zeros for those that have no score, their lengths, added up in order, and which aren't finite."""
    widths, starts, flat = vectors
    out = np.zeros((width, len(widths)))
    ok = np.flatnonzero(widths == width)
    some = flat[starts[ok][:, None] + np.arange(width)]
    bad = np.zeros(len(widths), bool)
    bad[ok] = ~np.isfinite(some).all(axis=1)
    some[bad[ok]] = 0
    out[:, ok] = some.T
    square = np.zeros(len(widths))
    for x in out:
        square += x * x
    return out, np.sqrt(square), bad


def _best(rows: pa.Table, asked: pa.Table, ties: list[str], once: bool, odd: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of questions, of their best rows, and the scores; ``rows`` lie in the order of ``ties``."""
    held, wanted, most = _widths(rows["_v"]), _widths(asked["_q"]), np.nan_to_num(asked["_most"].to_numpy()).astype(int)
    place = np.arange(len(rows))
    if once:
        new = np.arange(len(rows)) == 0
        for t in ties:
            codes = rows[t].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        place = np.cumsum(new) - 1
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    unit = lambda m, n: m / np.where(n > 0, n, 1)
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for width in np.unique(wanted[0]):
        some = np.flatnonzero((wanted[0] == width) & (most > 0))
        q, q_norm, q_bad = _matrix(wanted, max(width, 0))
        v, v_norm, v_bad = _matrix(held, max(width, 0))
        q_unit, v_unit = unit(q, q_norm), unit(v, v_norm)
        for lo in range(0, len(some), TILE):
            tile = some[lo : lo + TILE]
            near = q_unit[:, tile].T @ v_unit
            none = q_bad[tile][:, None] | v_bad
            if none.any():
                near[none] = 2.0 if np.isnan(odd) else odd
            top = near if len(starts) == len(place) else np.maximum.reduceat(near, starts, axis=1)
            k = min(int(most[tile].max()), top.shape[1])
            floor = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k]
            at, row = np.nonzero(near >= floor[:, None] - MARGIN)
            at = tile[at]
            dot = np.zeros(len(at))
            for a, b in zip(q, v, strict=True):
                dot += a[at] * b[row]
            n = q_norm[at] * v_norm[row]
            score = np.divide(dot, n, out=np.zeros(len(at)), where=n > 0)
            score[q_bad[at] | v_bad[row]] = odd
            order = np.lexsort((row, -np.where(np.isnan(score), 2.0, score), at))
            at, row, score = at[order], row[order], score[order]
            if once:
                first = np.sort(np.unique(at * len(place) + place[row], return_index=True)[1])
                at, row, score = at[first], row[first], score[first]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            good = rank < most[at]
            out.append((at[good], row[good], score[good]))
    at, row, score = map(np.concatenate, zip(*out, strict=True))
    return at, row, score
