"""Hard negatives by dual-tree search over integer vectors.

Anchors and candidates are each held in ball trees. For a pair of nodes the inner products of all their
rows lie within ``c·d ± (r|d| + s|c| + rs)`` (centres c, d, radii r, s), so a pair whose interval can't
improve any list of the anchor node is dropped with its whole subtree, for all its anchors at once. What
remains are pairs of leaves; their scores are computed exactly, best interval first, and the lists'
thresholds rise as they fill.

Plan: candidates are range-partitioned by label and dealt within it, so a hot label spreads over tasks; a
task builds trees of ``CHUNK`` rows and streams the anchors, ``BLOCK`` at a time, from the shared folder.
Rows never meet in a join, and a task emits at most k rows a list. Two searches run, positives and then
negatives between their bounds, each first over the candidates whose hash is divisible by ``SEED`` (their
k-th best is a floor that costs 1/SEED of the work), then over all candidates with that floor. The floor
only prunes: the second pass covers every row, so lists are exact. Work grows with anchors times
candidates where intervals don't prune, as for vectors without clusters.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Equal
rows count once. Rows that share an id but differ are different rows, ties between them go by a hash of
their content. Vectors of different lengths are compared as if the shorter ended in zeros. Components
saturate at 2^27 after scaling, so a score of up to 512 of them fits a long. Fewer rows than asked give
shorter lists; an empty table gives an empty result. Columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, require, table, written

#: Rows that a task holds in one tree, anchors it reads at a time, rows of a leaf.
CHUNK, BLOCK, LEAF = 1 << 16, 1 << 11, 128
#: Leaves that are scored before thresholds are looked at again.
STEP = 16
#: One candidate in so many gives the first thresholds.
SEED = 32
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
LIMIT = 1 << 27
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", relabel: Column | None = None) -> DataFrame:
    """``(key, label, v, tie)`` of rows that take part: components as whole numbers, equal rows once."""
    require(df, key, label, vector)
    x = F.col(vector)
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * 256), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    rows = df.where(good).select(F.col(key).cast("long").alias("key"), (relabel if relabel is not None else F.col(label)).cast("long").alias("label"), whole.alias("v"))
    return rows.withColumn("tie", F.xxhash64("label", "v")).dropDuplicates()


@dataclass
class Tree:
    """A ball tree: ``rows`` orders the points so that every node is a range."""

    points: np.ndarray
    rows: np.ndarray
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    kids: list[tuple[int, int] | None] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        tree = cls(points, np.arange(len(points)))
        centers, radii = [], []
        todo = [(0, len(points), None)]
        while todo:
            lo, hi, slot = todo.pop()
            mine = points[tree.rows[lo:hi]]
            center = mine.mean(axis=0)
            away = np.linalg.norm(mine - center, axis=1)
            me = len(tree.lo)
            tree.lo.append(lo)
            tree.hi.append(hi)
            tree.kids.append(None)
            centers.append(center)
            radii.append(away.max())
            if slot is not None:
                old = tree.kids[slot]
                tree.kids[slot] = (me,) if old is None else (*old, me)
            if hi - lo > leaf and away.max() > 0:
                # by the nearer of two far points, which keeps clusters whole, or in halves where that is lopsided
                one = mine[away.argmax()]
                other = mine[np.linalg.norm(mine - one, axis=1).argmax()]
                along = mine @ (other - one)
                mid = int((along < (one + other) @ (other - one) / 2).sum())
                if min(mid, hi - lo - mid) < (hi - lo) // 10:
                    mid = (hi - lo) // 2
                tree.rows[lo:hi] = tree.rows[lo:hi][np.argpartition(along, mid)]
                todo += [(lo, lo + mid, me), (lo + mid, hi, me)]
        tree.centers, tree.radii = np.array(centers), np.array(radii)
        tree.norms = np.linalg.norm(tree.centers, axis=1)
        return tree


#: Slack for the rounding of bounds, as a share of their size.
_SLACK = 1e-9


def interval(a: Tree, i: int, b: Tree, j: int) -> tuple[float, float]:
    """Bounds of the inner products of the rows of two nodes."""
    mid = float(a.centers[i] @ b.centers[j])
    wide = a.radii[i] * b.norms[j] + b.radii[j] * a.norms[i] + a.radii[i] * b.radii[j]
    wide += _SLACK * (a.norms[i] + a.radii[i]) * (b.norms[j] + b.radii[j]) + 1e-6
    return mid - wide, mid + wide


class Lists:
    """Top lists of the anchors of a block: ``k`` best of each of ``width`` lists an anchor, scores within a window.

    ``low`` and ``high`` (anchors x width) are inclusive; ``low`` rises once a list is full.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        none = np.empty(0, np.int64)
        self.found = {}
        self.none = (none, none, none)

    def span(self, anchors: np.ndarray) -> tuple[int, int]:
        """The scores that still matter to any list of these anchors."""
        open_ = self.low[anchors] <= self.high[anchors]
        if not open_.any():
            return 1, 0
        return int(self.low[anchors][open_].min()), int(self.high[anchors][open_].max())

    def offer(self, anchor: int, scores: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            ok = np.flatnonzero((scores >= self.low[anchor, w]) & (scores <= self.high[anchor, w]))
            if not len(ok):
                continue
            had = self.found.get((anchor, w), self.none)
            s, i, t = (np.concatenate([h, x[ok]]) for h, x in zip(had, (scores, keys, ties), strict=True))
            best = np.lexsort((t, i, -s))[: self.k]
            self.found[anchor, w] = s[best], i[best], t[best]
            if len(best) == self.k:
                self.low[anchor, w] = max(self.low[anchor, w], s[best[-1]])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as longs: by floats where these hold every partial sum, else by longs."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype(np.int64) if top < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(anchors: Tree, candidates: Tree, lists: Lists, anchor_keys: np.ndarray, anchor_ties: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> int:
    """Offer to the lists every candidate that can enter one, but an anchor itself; the number of scored pairs."""
    pairs: dict[int, list[tuple[float, int]]] = {}
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        least, most = lists.span(anchors.rows[anchors.lo[i] : anchors.hi[i]])
        low, high = interval(anchors, i, candidates, j)
        if least > most or high < least or low > most:
            continue
        left, right = anchors.kids[i], candidates.kids[j]
        if left is None and right is None:
            pairs.setdefault(i, []).append((high, j))
        elif right is None or left is not None and anchors.radii[i] > candidates.radii[j]:
            stack += [(x, j) for x in left]
        else:
            stack += [(i, x) for x in right]
    scored = 0
    for i, near in pairs.items():
        group = anchors.rows[anchors.lo[i] : anchors.hi[i]]
        near.sort(reverse=True)
        for at in range(0, len(near), STEP):
            some = near[at : at + STEP]
            least, most = lists.span(group)
            if least > most or some[0][0] < least:
                break
            rows = np.concatenate([candidates.rows[candidates.lo[j] : candidates.hi[j]] for _, j in some])
            scores = exact(anchors.points[group], candidates.points[rows])
            scored += scores.size
            for g, s in zip(group.tolist(), scores, strict=True):
                other = (keys[rows] != anchor_keys[g]) | (ties[rows] != anchor_ties[g])
                lists.offer(g, s[other], keys[rows][other], ties[rows][other])
    return scored


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, zeros after the end of shorter ones."""
    offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(offsets)
    out = np.zeros((len(lens), max(width, int(lens.max(initial=0)))))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(int(lens.sum())) - np.repeat(offsets[:-1] - offsets[0], lens)] = flat
    return out


def _blocks(path: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as src:
                yield from pq.ParquetFile(src).iter_batches(batch_size=BLOCK)


_HITS = "anchor long, anchor_tie long, list int, id long, tie long, score long"


def _search(path: str, k: int, same: bool):
    """An Arrow function from candidates to the best of each list of every anchor, of the anchors' label or of the others."""

    def chunk(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        keys, ties, labels = (rows[c].to_numpy(zero_copy_only=False) for c in ("key", "tie", "label"))
        points = _matrix(rows["v"], 0)
        trees = {}
        for l in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == l)
            trees[l] = Tree.of(points[mine]), keys[mine], ties[mine]
        for block in _blocks(path):
            if not block.num_rows:
                continue
            own = _matrix(block["v"], points.shape[1])
            a_keys, a_ties, a_labels = (block[c].to_numpy(zero_copy_only=False) for c in ("key", "tie", "label"))
            low, high = (np.array(block[c].to_pylist(), np.int64).reshape(block.num_rows, -1) for c in ("low", "high"))
            hits = []
            for al in np.unique(a_labels).tolist():
                mine = np.flatnonzero(a_labels == al)
                group = Tree.of(own[mine], 32)
                lists = Lists(low[mine], high[mine], k)
                for l, (tree, ids, t) in trees.items():
                    if (l == al) == same:
                        wide = tree if own.shape[1] == points.shape[1] else Tree.of(np.pad(tree.points, ((0, 0), (0, own.shape[1] - points.shape[1]))))
                        dual_search(group, wide, lists, a_keys[mine], a_ties[mine], ids, t)
                for (g, w), (s, i, t) in lists.found.items():
                    n = len(s)
                    hits.append((np.full(n, a_keys[mine[g]]), np.full(n, a_ties[mine[g]]), np.full(n, w, np.int32), i, t, s))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*hits, strict=True)], names=[c.split()[0] for c in _HITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK - n if n < CHUNK else CHUNK):
                part = batch.slice(at, CHUNK)
                held.append(part)
                n += part.num_rows
            if n >= CHUNK:
                yield from chunk(held)
                held, n = [], 0
        if n:
            yield from chunk(held)

    return run


def best(candidates: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``(anchor, anchor_tie, list, id, tie, score, rank)``: the ``k`` best candidates of every list of every anchor.

    ``anchors`` has ``key``, ``tie``, ``label``, ``v``, and ``low`` and ``high``, the bounds of each list.
    ``same`` takes candidates of the anchor's label, else those of all other labels.
    """
    rank = F.row_number().over(W.partitionBy("anchor", "anchor_tie", "list").orderBy(F.col("score").desc(), "id", "tie"))

    def pass_over(rows: DataFrame, asked: DataFrame) -> DataFrame:
        held = written(asked.select("key", "tie", "label", "v", "low", "high"), "anchors")
        hits = map_arrow(rows, _search(held.folder.toString(), k, same), _HITS)
        return written(hits.withColumn("rank", rank).where(F.col("rank") <= k), "hits")

    seeds = pass_over(candidates.where(F.pmod(F.xxhash64("key", "tie"), F.lit(SEED)) == 0), anchors)
    floors = seeds.where(F.col("rank") == k).groupBy(F.col("anchor").alias("key"), F.col("anchor_tie").alias("tie")).agg(F.map_from_entries(F.collect_list(F.struct("list", "score"))).alias("floors"))
    raised = anchors.join(floors, ["key", "tie"], "left")
    low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), F.lit(_LEAST))))
    return pass_over(candidates, raised.withColumn("low", low))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from the rows of ``usable``.

    An anchor's positives are its ``positives`` best rows of its label; a positive's negatives are the best rows
    of other labels whose score lies from ``low`` to ``high`` percent of the positive's.
    """
    rows = written(rows, "vectors")
    dealt = written(rows.repartitionByRange("label", "tie", "key"), "candidates")
    asked = rows.where(is_anchor)
    any_ = asked.withColumn("low", F.array(F.lit(_LEAST))).withColumn("high", F.array(F.lit(_MOST)))
    good = best(dealt, any_, positives, True)
    p = F.col("score")
    # low% and high% of the score, rounded inwards; a negative score leaves none, as its bounds cross
    share = lambda n: p.cast("decimal(20,0)") * n / 100
    least, most = F.ceil(share(low)).cast("long"), F.floor(share(high)).cast("long")
    windows = good.withColumn("w", F.struct("rank", F.col("id").alias("positive"), p.alias("score"), least.alias("low"), most.alias("high")))
    windows = windows.groupBy(F.col("anchor").alias("key"), F.col("anchor_tie").alias("tie")).agg(F.array_sort(F.collect_list("w")).alias("w"))
    with_windows = written(asked.join(windows, ["key", "tie"]).withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high")), "windows")
    found = best(dealt, with_windows, negatives, False)
    back = with_windows.select(F.col("key").alias("anchor"), F.col("tie").alias("anchor_tie"), F.posexplode("w").alias("list", "p"))
    return found.join(back, ["anchor", "anchor_tie", "list"]).select(
        F.col("anchor").alias("anchor_id"), F.col("p.positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def op13_negatives(spark, sf_dir) -> DataFrame:
    """The contract's anchors and labels over all embeddings."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), relabel=moved)
    return mine(rows, F.col("key") % 100 == 0)


ORACLE = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
