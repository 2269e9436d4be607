"""Benchmark decontamination: size-partitioned MinHash containment search.

An item leaks into a document when at least ``threshold`` of its distinct
five-word shingles occur in the document. A short item inside a long text has a
tiny Jaccard similarity with the whole text, so items are partitioned by size
and each partition searches windows of a matching length:

* a partition holds items of at most ``m`` shingles (``m`` a power of two);
* the document's shingles are cut into blocks of ``m / 4``; every run of five
  blocks is a window, so any ``m`` neighbouring shingles lie in one window;
* a window whose minimum under one of ``HASHES`` hash functions equals an
  item's is a candidate. At containment 0.8 the Jaccard similarity with the
  window is 0.296 or more, and all 32 hashes miss one window with odds of at
  most 1.4e-5;
* items of up to ``FEW`` shingles would be too small a part of any window. They
  are candidates wherever one of their shingles occurs, so none is missed.

Candidates are verified on the words themselves over the whole document.

Plan: one Arrow pass over the documents, no shuffle. Items are broadcast in blocks of
about ``ITEM_BYTES`` of text (measured before use), of which the driver holds one at a
time; more items mean more passes, so what is broadcast never grows. A Python worker
keeps the search tables of the block that it used last.

Words are runs of letters, marks, digits and underscores, lower-cased. An item
of fewer than five words is one shingle of its whole length; an item without
words never matches. Null texts hold no words. Repeated rows and repeated items repeat
results. A null id is an id like any other. Other columns stay as they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, table, written

WORDS = 5
THRESHOLD = 0.8
HASHES = 32
FEW = 4
ITEM_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
_NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"
_ODD = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(46)  # a filter of 2**18 slots


class Words:
    """The words of a batch of texts: dictionary, codes, 64-bit hashes and row bounds."""

    def __init__(self, texts: pa.Array, lower=pc.utf8_lower, gap: str = _NOT_WORD):
        split = pc.split_pattern(pc.replace_substring_regex(lower(texts.fill_null("")), gap, " "), " ")
        coded = split.flatten().dictionary_encode()
        self.dictionary = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.dictionary), np.uint64, len(self.dictionary))
        full = np.fromiter(map(bool, self.dictionary), bool, len(self.dictionary))[codes]
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        self.bounds = np.r_[0, np.cumsum(full)][bounds]
        self.codes = codes[full]
        self.hashes = hashes[self.codes]

    def row(self, i: int) -> list[str]:
        return [self.dictionary[c] for c in self.codes[self.bounds[i] : self.bounds[i + 1]]]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``n``-word shingles and the row of each, in order."""
        w = self.hashes
        size = np.maximum(np.diff(self.bounds) - n + 1, 0)
        if not size.sum():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            h *= _P
            h += w[k : len(w) - n + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        row = np.repeat(np.arange(len(size)), size)
        at = np.repeat(self.bounds[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return h[at], row


def grams(words: list[str], n: int = WORDS) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class Searcher:
    """Finds the items of one block in batches of texts."""

    def __init__(self, texts: list[str | None], threshold: float = THRESHOLD):
        words = Words(pa.array(texts, pa.string()))
        self.threshold = threshold
        self.words = words
        self.lengths: list[int] = []
        parts: dict[int, list[int]] = defaultdict(list)
        few: list[int] = []
        for i in range(len(texts)):
            own = words.row(i)
            n = min(WORDS, len(own))
            self.lengths.append(n)
            size = len(grams(own, n)) if n == WORDS else 0
            if n == WORDS and size <= FEW:
                few.append(i)
            elif n == WORDS:
                parts[max(8, 1 << (size - 1).bit_length())].append(i)
        hashes, row = words.shingles(WORDS)
        self.parts = []
        for m, items in sorted(parts.items()):
            keys, owner = [], []
            for k in range(HASHES):
                h = hashes * _ODD[k]
                low = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(low, row, h)
                order = np.argsort(low[items], kind="stable")
                keys.append(low[items][order])
                owner.append(np.array(items)[order])
            seen = np.zeros((HASHES, 1 << 18), bool)
            for k in range(HASHES):
                seen[k, keys[k] >> _TOP] = True
            self.parts.append((m // 4, keys, owner, seen))
        at = np.flatnonzero(np.isin(row, few))
        at = at[np.argsort(hashes[at], kind="stable")]
        self.few, self.few_owner, self.few_seen = hashes[at], row[at], np.zeros(1 << 18, bool)
        self.few_seen[self.few >> _TOP] = True
        self.short: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, n in enumerate(self.lengths):
            if 0 < n < WORDS:
                self.short[n][tuple(words.row(i))].append(i)
        self.known: dict[int, set] = {}

    def grams(self, i: int) -> set[tuple[str, ...]]:
        """The shingles of an item; of many items only those in use are kept."""
        if i not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[i] = grams(self.words.row(i), self.lengths[i])
        return self.known[i]

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """``(row, item)`` pairs that share a window minimum, or a shingle if the item has few."""
        hashes, row = words.shingles(WORDS)
        out: set[tuple[int, int]] = set()
        if len(self.few):
            hit = np.flatnonzero(self.few_seen[hashes >> _TOP])
            a, b = np.searchsorted(self.few, hashes[hit], "left"), np.searchsorted(self.few, hashes[hit], "right")
            for h, x, y in zip(hit[b > a], a[b > a], b[b > a], strict=True):
                out.update((int(row[h]), int(i)) for i in self.few_owner[x:y])
        if not len(hashes) or not self.parts:
            return out
        size = np.bincount(row, minlength=len(words.bounds) - 1)
        start = np.cumsum(size) - size
        finest = self.parts[0][0]
        blocks = -(-size // finest)
        owner = np.repeat(np.arange(len(size)), blocks)
        cut = np.repeat(start, blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * finest
        for k in range(HASHES):
            low = np.minimum.reduceat(hashes * _ODD[k], cut)
            own, step, first = owner, finest, np.cumsum(blocks) - blocks
            count = blocks
            for block, keys, items, seen in self.parts:
                while step < block:  # join neighbouring blocks of a row
                    count = -(-count // 2)
                    at = np.repeat(first, count) + 2 * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                    low = np.minimum.reduceat(low, at) if len(at) else low
                    own, first, step = own[at], np.cumsum(count) - count, step * 2
                window = low.copy()
                for j in range(1, 5):
                    same = own[j:] == own[:-j]
                    np.minimum(window[:-j], np.where(same, low[j:], window[:-j]), out=window[:-j])
                hit = np.flatnonzero(seen[k][window >> _TOP])
                if len(hit):
                    a = np.searchsorted(keys[k], window[hit], "left")
                    b = np.searchsorted(keys[k], window[hit], "right")
                    for h, x, y in zip(hit[b > a], a[b > a], b[b > a], strict=True):
                        out.update((int(own[h]), int(i)) for i in items[k][x:y])
        return out

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """``(row, item, shared, shingles)`` of every leak, verified word by word."""
        words = Words(texts)
        by_row: dict[int, list[int]] = defaultdict(list)
        for r, i in self.candidates(words):
            by_row[r].append(i)
        found = []
        for r, items in sorted(by_row.items()):
            own = grams(words.row(r))
            for i in sorted(items):
                shared, total = len(self.grams(i) & own), len(self.grams(i))
                if shared >= self.threshold * total - 1e-9:
                    found.append((r, i, shared, total))
        for n, known in self.short.items():
            for r in range(len(texts)):
                for g in grams(words.row(r), n) & known.keys():
                    found.extend((r, i, 1, 1) for i in known[g])
        return found


class Block:
    """A broadcast of item ids and texts with a name that workers know it by."""

    def __init__(self, spark, ids: list, texts: list):
        self.name = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast((ids, texts))

    @property
    def value(self):
        return self.sent.value


_last: dict[tuple, tuple[list, Searcher]] = {}


def searcher_of(block: Block, threshold: float) -> tuple[list, Searcher]:
    """Item ids and search tables of a block, made once a worker."""
    key = (block.name, threshold)
    if key not in _last:
        _last.clear()
        ids, texts = block.value
        _last[key] = ids, Searcher(texts, threshold)
    return _last[key]


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = ITEM_BYTES):
    """The items, broadcast in blocks of about ``most`` bytes of text; one block at a time is on the driver."""
    items = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, -(-int((size.b or 0) + 64 * size.n) // most))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        yield Block(items.sparkSession, [r[0] for r in rows], [r[1] for r in rows])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id, item, shared, shingles)``: every pair whose containment reaches the threshold."""
    found = []
    for block in item_blocks(items, item_col, item_text):

        def run(batches, block=block):
            names, searcher = searcher_of(block, threshold)
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
                for lo, hi in slices(sizes, BATCH_BYTES):
                    hits = searcher.search(b.column(1).slice(lo, hi - lo))
                    ids = b.column(0)
                    cols = [[ids[lo + r].as_py() for r, *_ in hits], [names[i] for _, i, *_ in hits], [h[2] for h in hits], [h[3] for h in hits]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "item", "shared", "shingles"])

        found.append(map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, "id long, item long, shared long, shingles long"))
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were.

    Each further block of items takes the rows that the one before has left, from a written table.
    """
    at = docs.columns.index(text_col)
    for k, block in enumerate(item_blocks(items, item_col, item_text)):

        def run(batches, block=block):
            searcher = searcher_of(block, threshold)[1]
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
                for lo, hi in slices(sizes, BATCH_BYTES):
                    part = b.slice(lo, hi - lo)
                    keep = np.ones(hi - lo, bool)
                    keep[[r for r, *_ in searcher.search(part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        docs = map_arrow(written(docs, "not-leaked") if k else docs, run, docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "shared", "shingles", F.round(F.col("shared") / F.col("shingles"), 6).alias("containment"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS shingles FROM bs GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id),
few AS (SELECT doc_id, item_id, 1 AS shared, 1 AS shingles FROM d, b WHERE len(b.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
SELECT doc_id, item_id, shared, shingles, round(shared / shingles, 6) AS containment
FROM (SELECT doc_id, item_id, shared, shingles FROM j JOIN n USING (item_id) UNION ALL FROM few) WHERE shared >= 0.8 * shingles - 1e-9
"""
