"""SimHash near-duplicate classes with BK-trees.

Every text gets a 64-bit SimHash of its word shingles. Two texts are linked
when their fingerprints differ in at most ``radius`` bits, and a class is a
connected component of those links.

Plan
----
1. Fingerprints are computed in one Arrow pass over whole texts and written to
   the shared folder together with the id; the texts never move.
2. Equal fingerprints collapse to one row (``min(doc_id)``), so a huge group of
   copies is one node; its rows get their class back over many tasks.
3. Shards. 64 bits are cut into six blocks. Fingerprints within two bits agree
   on at least four whole blocks, so each fingerprint joins C(6,4) = 15 shards,
   each keyed by four blocks. Members of a shard differ in at most 22 free
   bits: a shard holds at most 2**22 fingerprints, whatever the input.
4. Each shard becomes a BK-tree (a child hangs under its parent at their integer
   Hamming distance). Probes follow only edges whose distance lies within the
   radius of the probe's own distance to the parent. All shard trees of a slice
   are built and probed together as arrays. Links are reduced to a spanning
   forest per shard, so a dense group emits one edge per member, not all pairs.
   Memory: about 110 bytes a fingerprint of a slice, and the chunks of one walk.
5. Connected components by alternating large-star / small-star steps, each
   written to the shared folder. The links of a hub are dealt over many tasks.

Null or blank texts have fingerprint zero and are linked like any other row.
Rows with a null id are kept and classed, but cannot name a class unless all
ids of the class are null. Repeated rows come out as often as they went in.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, slices, spread_join, table, written

SEED = 42
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Rows gathered before a forest of shard trees is built; a cut falls between shards only.
SLICE_ROWS = 100_000
#: Probes that walk the forest together, so the frontier stays small.
PROBES = 4096
#: Pairs of probe and node that one step of the walk visits.
FRONTIER = 1 << 16


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of the ``n``-word shingles (repeats count) of an ASCII-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < n:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    xx = xxhash.xxh64_intdigest
    ones, total, block = np.zeros(64, np.int64), 0, []

    def count() -> None:
        nonlocal total, ones
        a = np.array(block, dtype="<u8")
        ones += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(block)
        block.clear()

    for g in grams:
        block.append(xx(g, SEED))
        if len(block) == 65536:
            count()
    if block:
        count()
    bits = np.packbits((ones * 2 > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """``(id, fp)``: one signed 64-bit fingerprint per row."""

    def run(batches):
        for b in batches:
            # one text at a time, so a worker holds no second copy of the batch
            fps = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)), run, "id long, fp long")


def shard_masks(radius: int = 2) -> list[int]:
    """Masks whose blocks two fingerprints within ``radius`` bits must share in one case at least."""
    if not 0 <= radius < len(BLOCKS):
        raise ValueError("radius must be below the number of blocks")
    spans, at = [], 0
    for width in BLOCKS:
        spans.append(((1 << width) - 1) << at)
        at += width
    masks = [sum(keep) for keep in combinations(spans, len(BLOCKS) - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def build_forest(shard: np.ndarray, fp: np.ndarray) -> dict[str, np.ndarray]:
    """BK-trees of all shards at once. ``shard`` is sorted; fingerprints of a shard are distinct.

    ``first``/``last`` delimit each node's children, ordered by edge distance.
    """
    n = len(fp)
    parent, edge = np.full(n, -1, np.int32), np.zeros(n, np.int8)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(starts, np.diff(np.r_[starts, n])).astype(np.int32)
    left, at = np.flatnonzero(root != np.arange(n)).astype(np.int32), root.copy()
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[at[left]]).astype(np.int8)
        order = np.lexsort((left, d, at[left]))
        items, dist, under = left[order], d[order], at[left][order]
        head = np.r_[True, (under[1:] != under[:-1]) | (dist[1:] != dist[:-1])]
        child = items[np.maximum.accumulate(np.where(head, np.arange(len(items)), 0))]
        parent[items[head]], edge[items[head]] = under[head], dist[head]
        at[items] = child
        left = items[~head]
    kids = np.flatnonzero(parent >= 0).astype(np.int32)
    kids = kids[np.lexsort((edge[kids], parent[kids]))]
    last = np.cumsum(np.bincount(parent[kids], minlength=n))
    first = np.r_[0, last[:-1]]
    return {"fp": fp, "root": root, "edge": edge, "kids": kids, "first": first, "last": last}


def probe_forest(forest: dict[str, np.ndarray], radius: int):
    """Yield ``(probe, node)`` arrays of links, each found once (``node < probe``).

    The walk goes depth first over chunks of the frontier: a chunk visits at most ``FRONTIER`` pairs or one
    probe's children, and a tree of depth d keeps d chunks open, so a dense shard costs time but not memory.
    """
    fp, edge, kids, first, last = (forest[k] for k in ("fp", "edge", "kids", "first", "last"))
    size = np.bincount(forest["root"], minlength=len(fp))[forest["root"]]
    probes = np.flatnonzero(size > 1).astype(np.int32)
    for lo in range(0, len(probes), PROBES):
        q = probes[lo : lo + PROBES]
        open_ = [(q, forest["root"][q])]
        while open_:
            q, node = open_.pop()
            d = np.bitwise_count(fp[q] ^ fp[node])
            hit = (d <= radius) & (node < q)
            if hit.any():
                yield q[hit], node[hit]
            counts = last[node] - first[node]
            some = np.flatnonzero(counts)
            q, node, d, counts = q[some], node[some], d[some], counts[some]
            for a, b in slices(counts, FRONTIER):
                part = counts[a:b]
                starts = first[node[a:b]] - (np.cumsum(part) - part)
                child = kids[np.repeat(starts, part) + np.arange(int(part.sum()))]
                near = np.abs(edge[child] - np.repeat(d[a:b], part).astype(np.int8)) <= radius
                open_.append((np.repeat(q[a:b], part)[near], child[near]))


def spanning_edges(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Per shard, an edge from each linked member to the first member of its local component, as positions."""
    label = np.arange(len(fp), dtype=np.int32)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if (up == x).all():
                return x
            x = up

    for a, b in probe_forest(build_forest(shard, fp), radius):
        while len(a):
            a, b = find(a), find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            label[np.maximum(a, b)] = np.minimum(a, b)
        label = find(np.arange(len(fp), dtype=np.int32))
    members = np.flatnonzero(label != np.arange(len(fp)))
    return members, label[members]


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links among distinct fingerprints ``(fp)`` as a spanning forest of each shard: ``(u, v)`` with ``u > v``."""
    masks = shard_masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    shards = nodes.select("fp", F.explode(keys).alias("s")).select("s.t", "s.k", "fp")

    def run(batches):
        def edges(t, k, fp):
            shard = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            busy = np.bincount(shard)[shard] > 1
            if busy.any():
                fp = fp[busy]
                a, b = spanning_edges(shard[busy], fp.view(np.uint64), radius)
                a, b = fp[a], fp[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

        held, rows = [], 0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            if rows >= SLICE_ROWS:
                t, k, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero((t != t[-1]) | (k != k[-1])).max(initial=-1)) + 1
                if cut:
                    yield from edges(t[:cut], k[:cut], fp[:cut])
                held, rows = [[x[cut:] for x in (t, k, fp)]], rows - cut
        if rows:
            yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    spread = shards.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    return map_arrow(spread, run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable from every node that has a link; nodes are of any ordered type.

    Alternates large-star and small-star; each round's edges are written to the
    shared folder and the loop ends when a round changes nothing.
    """
    edges = written(edges, "links")
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "hubs")
        large = spread_join(both.where("v > u"), hubs.select("u", "m"), ["u"], "v", hubs.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low.select("u", "m"), ["u"], "v", low.select("u", "n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        for done in (before, hubs, large):
            discard(done)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def named_classes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``(node, component)``: the least ``rep`` of the class of every node ``(node, rep)``; ``found`` has nodes with links."""
    rooted = written(nodes.join(found, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n")), "names")
    return spread_join(rooted.select("node", "root"), names.select("root", "component"), ["root"], None, names.select("root", "n")).select("node", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``; ``component`` is the smallest id reachable.

    Rows are told apart by id and fingerprint, so rows that repeat an id with other texts keep classes of their own.
    """
    rows = written(fingerprints(docs, id_col, text_col, n), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    classes = named_classes(nodes.withColumnRenamed("fp", "node"), components(near_links(nodes.select("fp"), radius))).withColumnRenamed("node", "fp")
    return spread_join(rows, classes, ["fp"], None, nodes.select("fp", "n")).select("id", "fp", "component")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
