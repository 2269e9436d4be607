"""Near copies by SimHash and Jaccard similarity of word shingles.

Two texts are linked when the sets of their five-word shingles have a Jaccard
similarity of ``LEAST`` or more; a class is a connected component of links.

Plan
----
1. One Arrow pass gives every text its SimHash (``simhash.fingerprint`` over the same
   shingles), a digest of its shingle set and ``BANDS`` keys, each of ``ROWS`` MinHash
   values. Equal sets collapse to one node.
2. The shards of BK-trees of ``simhash`` link fingerprints within ``RADIUS`` bits. Links
   that hold on the words of both texts form the first classes.
3. Two bits hold a small part of the pairs near ``LEAST``, so nodes of different classes
   that share a MinHash key are candidates, too: two texts at similarity 0.8 share none with
   odds (1 - 0.8^5)^32, about 3e-6. First each is compared with the smallest node of its
   key, so a large group of near copies costs one pair a member.
4. Keys whose nodes are not all in one class are compared further, in cells of about
   twice ``GROUP`` nodes, whatever the key's size: the key's largest class is cut into
   chunks, and each chunk meets the rest of the key. Pairs of one class are passed over,
   as are pairs of which under ``AGREE`` of the 160 MinHash bytes agree (at similarity
   0.8 odds of about 1e-7). Only links leave a task.
5. Where over ``GROUP`` nodes of a key are outside its largest class, the key says little:
   its texts share a passage. They are regrouped by the rarest fifth of their shingles
   (prefix filter: sets of similarity 0.8 share one of these, in any fixed order), and
   then compared as in 4. Rarity comes from a table of ``SLOTS`` counters.
6. Links are verified on the words of both texts.

A row is told from others by its id and its text, so rows that repeat an id with
different texts have classes of their own; equal rows share one. Rows without an
id are left out. Ties: the class is named by its smallest id, and of rows with that id
the one with the least text hash is first.

Words are runs of other characters than ASCII white space, ASCII-lower-cased, as
in ``simhash``. A text of fewer than five words is one shingle of its whole length;
texts without words are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, spread_join, written
from .decontaminate import Words
from .simhash import components, fingerprint, named_classes, near_links

WORDS = 5
LEAST = 0.8
#: Bits in which linked fingerprints may differ.
RADIUS = 2
BANDS, ROWS = 32, 5
AGREE = 99
#: Nodes of a chunk; a cell has two.
GROUP = 256
#: Counters of shingles, by hash.
SLOTS = 1 << 18
BATCH_BYTES = 2 << 20
_GAP = r"[\t-\r ]+"
_ODD = np.random.default_rng(11).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> frozenset[tuple[bytes, ...]]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(WORDS, len(words))
    return frozenset(zip(*(words[i:] for i in range(n)), strict=False)) if n else frozenset()


def similarity(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def keys_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, list[np.ndarray | None], list[bytes | None]]:
    """Digest of the shingle set, its size, band keys and MinHash bytes of every text; a text under five words has no keys."""
    words = Words(texts, pc.ascii_lower, _GAP)
    hashes, row = words.shingles(WORDS)
    size = np.bincount(row, minlength=len(texts)).astype(np.int64)
    start = np.cumsum(size) - size
    digests, distinct = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        if size[i]:
            own = np.unique(hashes[start[i] : start[i] + size[i]])
            distinct[i] = len(own)
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
        else:
            own = words.row(i)
            distinct[i] = bool(own)
            digests.append(xxhash.xxh3_128_digest("\x00".join(["short", *own]).encode("utf-8", "surrogatepass")))
    keys: list[np.ndarray | None] = [None] * len(texts)
    sigs: list[bytes | None] = [None] * len(texts)
    full = np.flatnonzero(size)
    if len(full):
        bands, low = np.empty((len(full), BANDS), np.uint64), np.empty((len(full), BANDS * ROWS), np.uint8)
        for j in range(BANDS):
            k = np.full(len(full), j + 1, np.uint64)
            for i, odd in enumerate(_ODD[j]):
                least = np.minimum.reduceat(hashes * odd, start[full])
                low[:, j * ROWS + i] = (least * _P) >> np.uint64(56)
                k = (k ^ least) * _P
                k ^= k >> np.uint64(29)
            bands[:, j] = k
        for i, b, m in zip(full, bands.view(np.int64), low, strict=True):
            keys[i], sigs[i] = b, m.tobytes()
    return digests, distinct, keys, sigs


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, digest, size, keys, sig, fp)`` for every row; ``th`` is a hash of the text, ``fp`` its SimHash."""

    def run(batches):
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                digests, size, keys, sigs = keys_of(part.column(2))
                fps = np.array([fingerprint(t.as_py(), WORDS) for t in part.column(2)], np.uint64).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(size), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(fps)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "digest", "size", "keys", "sig", "fp"])

    return map_arrow(keyed(docs, id_col, text_col), run, "id long, th long, digest binary, size long, keys array<long>, sig binary, fp long")


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """Candidates ``(u, v)`` among ``nodes (node, fp, size)``: what the BK-trees link, and nodes of one fingerprint.

    The smallest node of a fingerprint stands for it.
    """
    low = F.min(F.struct("node", "size")).alias("low")
    held = written(nodes.groupBy("fp").agg(low, F.count(F.lit(1)).alias("n")), "fingerprints")
    same = spread_join(nodes, held.where("n > 1").select("fp", "low"), ["fp"], "node", held.select("fp", "n")).where(F.col("node") != F.col("low.node"))
    same = same.select("node", "size", F.col("low.node").alias("v"), F.col("low.size").alias("v_size"))
    near = written(near_links(held.select("fp"), radius), "near")
    for end in ("u", "v"):  # a hub has many links
        counts = written(near.groupBy(end).agg(F.count(F.lit(1)).alias("n")), "ends")
        near = spread_join(near, held.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_low")), [end], "u" if end == "v" else "v", counts)
    found = same.unionByName(near.select(F.col("u_low.node").alias("node"), F.col("u_low.size").alias("size"), F.col("v_low.node").alias("v"), F.col("v_low.size").alias("v_size")))
    return found.where(alike(F.col("size"), F.col("v_size"), least)).select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs ``(u, v)`` whose texts ``(node, text)`` are similar enough."""

    def run(batches):
        held: tuple = (None, None)
        for b in batches:
            us, vs = [], []
            for u, v, a, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if held[0] != c:
                    held = (c, shingle_set(c))
                if similarity(shingle_set(a), held[1]) >= least - 1e-9:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    for end, text in (("u", "a"), ("v", "b")):
        counts = written(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")), "ends")
        pairs = spread_join(pairs, texts.select(F.col("node").alias(end), F.col("text").alias(text)), [end], "u" if end == "v" else "v", counts)
    return map_arrow(pairs.select("u", "v", "a", "b"), run, "u binary, v binary").distinct()


def apart_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose nodes are of different classes by ``labels (node, root)``."""
    for end in ("u", "v"):
        counts = written(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")), "ends")
        roots = labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = spread_join(pairs, roots, [end], "u" if end == "v" else "v", counts, how="left")
    return pairs.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def cells(members: DataFrame, stats: DataFrame) -> DataFrame:
    """``members (key, node, size, root)`` dealt into cells of about twice ``GROUP`` rows: ``(key, cell, part, node, size, root)``.

    Every two nodes of a key and of different roots meet in a cell, where their ``part`` differs or is -1.
    ``stats`` has ``n``, the largest root ``main`` and its ``n_main`` of each key.
    """
    rows = spread_join(members, stats, ["key"], None, stats.select("key", "n"))
    chunks = rows.withColumn("gm", F.ceil(F.col("n_main") / GROUP).cast("int")).withColumn("gr", F.ceil((F.col("n") - F.col("n_main")) / GROUP).cast("int"))
    chunks = chunks.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("main"), F.col("gm")).otherwise(F.col("gr"))).cast("int"))

    def place(kind: str, a, b, part):
        return F.struct(F.concat(F.lit(kind), a.cast("string"), F.lit("-"), b.cast("string")).alias("cell"), part.cast("int").alias("part"))

    own, both = F.col("own"), F.lit(-1)
    main = F.transform(F.sequence(F.lit(0), F.col("gr") - 1), lambda j: place("m", own, j, F.lit(0)))
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("gm") - 1), lambda i: place("m", i, own, F.lit(1))),
        F.transform(F.sequence(F.lit(0), F.col("gr") - 1), lambda j: place("r", F.least(own, j), F.greatest(own, j), F.when(j == own, both).otherwise((own > j).cast("int")))),
    )
    places = F.when(F.col("n") <= GROUP, F.array(place("", F.lit(0), F.lit(0), both))).when(F.col("root") == F.col("main"), main).otherwise(rest)
    return chunks.withColumn("at", F.explode(places)).select("key", "at.cell", "at.part", "node", "size", "root")


def crossing(members: DataFrame, least: float = LEAST) -> DataFrame:
    """Links ``(u, v)`` between classes among the ``members (key, cell, part, node, size, root, sig, text)`` of each cell."""

    def links(part, nodes, size, root, sigs, texts):
        bytes_ = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(nodes), -1)
        near = int(AGREE * least / LEAST)
        known: dict[int, frozenset] = {}
        known_words: dict[int, frozenset] = {}

        def hashes(i: int) -> frozenset:
            if i not in known:
                known[i] = frozenset(Words(pa.array([texts[i]], pa.string()), pc.ascii_lower, _GAP).shingles(WORDS)[0].tolist())
            return known[i]

        def words(i: int) -> frozenset:
            if i not in known_words:
                known_words[i] = shingle_set(texts[i])
            return known_words[i]

        cls = np.unique(np.array(root, object), return_inverse=True)[1]
        for i in range(1, len(nodes)):
            js = np.flatnonzero((cls[:i] != cls[i]) & ((part[:i] != part[i]) | (part[i] < 0)) & (np.minimum(size[:i], size[i]) >= np.maximum(size[:i], size[i]) * least - 1e-9))
            for j in js[(bytes_[js] == bytes_[i]).sum(1) >= near].tolist():
                if cls[i] != cls[j] and similarity(hashes(i), hashes(j)) >= least - 1e-9 and similarity(words(i), words(j)) >= least - 1e-9:
                    cls[cls == cls[i]] = cls[j]  # linked classes need no second link
                    yield max(nodes[i], nodes[j]), min(nodes[i], nodes[j])

    def run(batches):
        last, held = None, []

        def flush():
            part, nodes, size, root, sigs, texts = zip(*held, strict=True)
            out = list(links(np.array(part), nodes, np.array(size), root, sigs, texts)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[e] for p in out], pa.binary()) for e in (0, 1)], names=["u", "v"])

        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for r, key in enumerate(keys):
                if held and key != last:
                    yield flush()
                    held = []
                last = key
                held.append([c[r].as_py() for c in b.columns[2:]])
        if held:
            yield flush()

    dealt = members.select("key", "cell", "part", "node", "size", "root", "sig", "text").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    return map_arrow(dealt, run, "u binary, v binary").distinct()


def rare_shingles(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """``(key, node, size, root)``: of texts ``(node, text, size, root)`` the shingles of which similar texts share one."""

    def shingles(batches):
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, BATCH_BYTES):
                hashes, row = Words(b.column(1).slice(lo, hi - lo), pc.ascii_lower, _GAP).shingles(WORDS)
                yield b.slice(lo, hi - lo), hashes, np.searchsorted(row, np.arange(hi - lo + 1))

    def count(batches):
        seen = np.zeros(SLOTS, np.int64)
        for part, hashes, cut in shingles(batches):
            for i in range(part.num_rows):
                np.add.at(seen, np.unique(hashes[cut[i] : cut[i + 1]]) % np.uint64(SLOTS), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])

    counts = map_arrow(texts.select("node", "text"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = np.zeros(SLOTS, np.int64)
    found = counts.toArrow()  # at most SLOTS rows
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()

    def prefixes(batches):
        for part, hashes, cut in shingles(batches):
            keys, rows = [np.empty(0, np.int64)], []
            for i in range(part.num_rows):
                own = np.unique(hashes[cut[i] : cut[i + 1]])
                n = len(own) - int(np.ceil(least * len(own) - 1e-6)) + 1
                keys.append(own[np.lexsort((own, table[own % np.uint64(SLOTS)]))[:n]].view(np.int64))
                rows += [i] * len(keys[-1])
            same = part.select([0, 2, 3]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *same.columns], names=["key", "node", "size", "root"])

    return map_arrow(texts.select("node", "text", "size", "root"), prefixes, "key long, node binary, size long, root binary")


def mixed(members: DataFrame) -> DataFrame:
    """Of keys whose ``members (key, node, size, root)`` have several roots: their rows ``n``, largest root ``main`` and its rows ``n_main``."""
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    stats = by_root.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots"))
    return stats.where("roots > 1").select("key", "n", F.col("m.root").alias("main"), F.col("m.c").alias("n_main"))


def alike(a, b, least: float = LEAST):
    """Whether sets of such sizes can reach the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * least - 1e-9


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(id, th, n, component, first)`` for every distinct row ``(id, th)``: ``n`` times there; ``first`` in its class or not."""
    docs = docs.where(F.col(id_col).isNotNull())
    rows = written(signatures(docs, id_col, text_col), "signatures")
    rep = F.min(F.struct("id", "th")).alias("rep")
    nodes = rows.groupBy("digest").agg(rep, F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.min("fp").alias("fp"))
    nodes = written(nodes.withColumnRenamed("digest", "node"), "nodes")
    members = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = written(members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = written(spread_join(members, shared.select("key", "low"), ["key"], None, shared.select("key", "n")), "members")
    by_bits = written(fingerprint_pairs(nodes.where("keys is not null").select("node", "fp", "size"), RADIUS, least), "by-bits")
    ends = by_bits.select(F.explode(F.array("u", "v")).alias("node"))
    wanted = members.select("node").unionByName(ends).distinct().join(nodes.select("node", "rep.*", "sig"), "node")
    texts = keyed(docs, id_col, text_col).join(wanted.hint("merge"), ["id", "th"])
    # rows that repeat count once; the join's order serves
    once = texts.groupBy("id", "th").agg(F.first("node").alias("node"), F.first("sig").alias("sig"), F.first("text").alias("text"))
    texts = written(once.select("node", "sig", "text"), "texts")

    near = written(verified(by_bits, texts, least), "near-links")
    first = members.where((F.col("node") != F.col("low.node")) & alike(F.col("size"), F.col("low.size"), least)).select(F.col("node").alias("u"), F.col("low.node").alias("v")).distinct()
    first = apart_pairs(written(first, "pairs"), written(components(near), "near-classes"))
    links = written(near.unionByName(verified(written(first, "first-pairs"), texts, least)), "verified")
    labels = written(components(links), "labels")
    apart = written(members.select("key", "node", "size").join(labels, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "apart")
    stats = written(mixed(apart), "mixed")

    vague = stats.where(f"n - n_main > {GROUP}").select("key")
    loose = written(apart.join(vague, "key").groupBy("node").agg(F.first("size").alias("size"), F.first("root").alias("root")), "loose")
    tokens = written(rare_shingles(texts.join(loose, "node"), least), "tokens")
    met = cells(apart, stats.where(f"n - n_main <= {GROUP}")).unionByName(cells(tokens, written(mixed(tokens), "mixed-tokens")))
    found = components(links.unionByName(crossing(met.join(texts, "node"), least)))

    named = written(named_classes(nodes.select("node", "rep"), found), "classes")
    distinct = rows.groupBy("id", "th", "digest").agg(F.count(F.lit(1)).alias("n"))
    out = spread_join(distinct.withColumnRenamed("digest", "node"), named, ["node"], "id", nodes.select("node", "n"))
    return out.select("id", "th", "n", F.col("component.id").alias("component"), (F.struct("id", "th") == F.col("component")).alias("first"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(id, component)`` for every row with an id; ``component`` is the smallest id reachable."""
    found = classes(docs, id_col, text_col, least)
    return found.select(F.explode(F.sequence(F.lit(1), F.col("n"))), "id", "component").select("id", "component")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each class, all columns as they were; rows without an id stay.

    Of rows that repeat the class's first id and text the one whose other columns come first stays.
    """
    kept = written(classes(docs, id_col, text_col, least).where("first").select("id", "th"), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs is in the way
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    keyed_rows = whole.where(F.col(own).isNotNull()).withColumn("id", F.col(own).cast("long")).withColumn("th", F.xxhash64(text))
    # the same join at every size: each text moves once, and the join's order serves the aggregation
    rows = keyed_rows.join(kept.hint("merge"), ["id", "th"])
    others = F.to_json(F.struct(*[c for c in names if c != text]))
    once = rows.groupBy("id", "th").agg(F.min_by(F.struct(*names), others).alias("row"))
    out = once.select("row.*").unionByName(whole.where(F.col(own).isNull()))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
