"""Candidates against evidence: timelines, audio-visual matrix.

A token occurs in a text if some run of its letters and digits holds it, so a text is
cut into distinct runs once and each run is looked up in a table of the tokens; the
texts are read once for all candidates. A task keeps one row a candidate, and only
those rows meet. Candidates travel with the task in blocks of at most
``BLOCK`` of them: more candidates mean more passes, never a larger closure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_tokens, token_hits
from ..runtime import map_arrow, slices

BLOCK = 512
#: Bytes of runs that a task remembers with their tokens, and what a run takes besides its letters.
CACHE, RUN_BYTES = 24 << 20, 170
#: Texts that are matched at once, and about their bytes.
ROWS, PIECE = 256, 1 << 20
_NONE = np.empty(0, np.int32)
_RUN = re.compile(r"[a-z0-9\u4e00-\u9fff]+")


class Finder:
    """Which tokens of a fixed list occur in texts."""

    def __init__(self, tokens: list[str]):
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.lengths = sorted({len(t) for t in tokens})
        self.known: dict[str, np.ndarray] = {}
        self.size = 0

    def in_run(self, run: str) -> np.ndarray:
        found = self.known.get(run)
        if found is None:
            if len(run) <= 64:
                hits = {self.ids[s] for n in self.lengths if n <= len(run) for i in range(len(run) - n + 1) if (s := run[i : i + n]) in self.ids}
            else:
                hits = {i for t, i in self.ids.items() if t in run}
            found = np.fromiter(sorted(hits), np.int32, len(hits)) if hits else _NONE
            self.size += len(run) + RUN_BYTES + (found.nbytes + 112 if hits else 0)
            if self.size > CACHE:
                self.known.clear()
                self.size = 0
            self.known[run] = found
        return found

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """(texts, tokens) flags."""
        out = np.zeros((len(texts), len(self.ids)), np.float32)
        for r, t in enumerate(texts):
            for run in set(_RUN.findall((t or "").lower())):
                out[r, self.in_run(run)] = 1
        return out


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``ROWS`` rows and about ``PIECE`` bytes of text, so no worker holds it as objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in slices(np.maximum(sizes, PIECE // ROWS), PIECE):
        yield batch.slice(lo, hi - lo)


def candidate_blocks(candidates: DataFrame) -> Iterator[list[tuple[str, list[str]]]]:
    """``(label, tokens)`` in blocks of about ``BLOCK``, one at a time on the driver."""
    c = candidates.select("label", content_tokens("text").alias("tokens"))
    n = -(-c.count() // BLOCK)
    for k in range(n):
        yield [(r["label"], r["tokens"] or []) for r in c.where(F.pmod(F.xxhash64("label"), F.lit(n)) == k).collect()]


def _weights(block: list[tuple[str, list[str]]], most: int | None = None, distinct: bool = False) -> tuple[Finder, np.ndarray, np.ndarray]:
    """A finder of the block's tokens, how often each candidate holds each, and each candidate's tokens."""
    lists = [list(dict.fromkeys(ts)) if distinct else ts for _, ts in block]
    lists = [ts[:most] for ts in lists] if most else lists
    finder = Finder(sorted({t for ts in lists for t in ts}))
    table = np.zeros((len(finder.ids), len(block)), np.float32)
    for c, ts in enumerate(lists):
        for t in ts:
            table[finder.ids[t], c] += 1
    return finder, table, np.array([len(ts) for ts in lists])


def best_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(label, hits, t, ord)``: each candidate's best text of every task."""
    parts = []
    for block in candidate_blocks(candidates):

        def run(batches, block=block):
            finder, table, n = _weights(block)
            need, best = np.where(n <= 2, 1, 2), {}
            for b in batches:
                for part in pieces(b, 2):
                    ord_, t = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    hits = finder.rows(part.column(2).to_pylist()) @ table
                    order = np.lexsort((ord_, t))
                    top = order[hits[order].argmax(0)]
                    for c in np.flatnonzero((hits[top, np.arange(len(block))] >= need) & (n > 0)):
                        r = top[c]
                        best[c] = max(best.get(c, (0,)), (int(hits[r, c]), -float(t[r]), -int(ord_[r])))
            rows = [(block[c][0], h, -t, -o) for c, (h, t, o) in best.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["label", "hits", "t", "ord"])

        rows = evidence.select(F.col("ord").cast("long"), F.col("t").cast("double"), "text").where("t is not null and ord is not null")
        parts.append(map_arrow(rows, run, "label string, hits long, t double, ord long"))
    if not parts:
        return evidence.sparkSession.createDataFrame([], "label string, hits long, t double, ord long")
    return reduce(DataFrame.unionByName, parts)


def candidate_timeline(candidates: DataFrame, evidence: DataFrame, case: str | None = None) -> DataFrame:
    """Best evidence of each candidate ``(label, text)``: most tokens found, then earliest, then first.

    ``evidence(ord, t, text)``. A candidate with two tokens or fewer needs one hit, others two.
    With a ``case`` column candidates meet the evidence of their own case only, by an equi-join.
    """
    keys = [case] if case else []
    c = candidates.select(*keys, F.col("label").cast("string").alias("label"), content_tokens("text").alias("tokens"))
    if case:
        # folded below the join: within the token filter it would be folded once a token
        pairs = evidence.withColumn("low", F.lower("text")).drop("text").join(c, case).withColumn("hits", token_hits("low", F.col("tokens")).cast("long"))
        pairs = pairs.where((F.size("tokens") > 0) & (F.col("hits") >= F.when(F.size("tokens") <= 2, 1).otherwise(2)))
    else:
        pairs = best_evidence(candidates.select(F.col("label").cast("string").alias("label"), "text"), evidence)
    best = pairs.groupBy(*keys, "label").agg(F.max(F.struct("hits", (-F.col("t")).alias("nt"), (-F.col("ord")).alias("no"))).alias("b"))
    out = c.join(best, [*keys, "label"], "left")
    return out.select(*keys, "label", F.when(F.col("b").isNull(), "missing").otherwise("found").alias("status"), (-F.col("b.nt")).alias("t"), (-F.col("b.no")).alias("ord"), F.coalesce("b.hits", F.lit(0)).alias("hits"))


def recommended_order(timeline: DataFrame, case: str | None = None) -> DataFrame:
    """Found labels by time and whether all were found."""
    found = F.filter(F.array_sort(F.collect_list(F.when(F.col("status") == "found", F.struct("t", "label")))), lambda x: x.isNotNull())
    agg = [F.transform(found, lambda x: x["label"]).alias("recommended_order"), F.min(F.col("status") == "found").alias("coverage_ok")]
    return timeline.groupBy(case).agg(*agg) if case else timeline.agg(*agg)


def seen_in(options: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(label, seen, ord)`` of options ``(label, text)`` against ``evidence(ord, text)``.

    Seen is an option with all of its first six tokens in one text, or with two of its
    distinct tokens there (one, if it has one), or with its first six spread over all texts.
    ``ord`` is the first text of the first kind, else the one with most tokens.
    """
    parts = []
    for block in candidate_blocks(options):

        def run(batches, block=block):
            finder, every, n = _weights(block, distinct=True)
            _, first, six = _weights([(label, [t for t in ts[:6]]) for label, ts in block], distinct=True)
            at = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts[:6]}))}
            wide = np.zeros((len(finder.ids), len(block)), np.float32)
            for t, i in at.items():
                wide[finder.ids[t]] = first[i]
            need, full, some, spread = np.minimum(2, n), {}, {}, np.zeros(len(finder.ids), bool)
            for b in batches:
                for part in pieces(b, 1):
                    ord_ = part.column(0).to_numpy(zero_copy_only=False)
                    flags = finder.rows(part.column(1).to_pylist())
                    spread |= flags.any(0)
                    order = np.argsort(ord_, kind="stable")
                    whole = (flags @ wide)[order] >= six
                    hits = (flags @ every)[order]
                    for c in np.flatnonzero(whole.any(0) & (six > 0)):
                        o = int(ord_[order[whole[:, c].argmax()]])
                        full[c] = min(full.get(c, o), o)
                    top = hits.argmax(0)
                    for c in np.flatnonzero((hits[top, np.arange(len(block))] >= need) & (n > 0)):
                        some[c] = max(some.get(c, (0,)), (int(hits[top[c], c]), -int(ord_[order[top[c]]])))
            inverse = list(finder.ids)
            here = {inverse[i] for i in np.flatnonzero(spread)}
            rows = [(label, full.get(c), *(some.get(c) or (None, None)), sorted(here.intersection(ts[:6])), list(dict.fromkeys(ts[:6]))) for c, (label, ts) in enumerate(block)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, types, strict=True)], names=["label", "full", "hits", "no", "found", "six"])

        rows = evidence.select(F.col("ord").cast("long"), "text").where("ord is not null")
        parts.append(map_arrow(rows, run, "label string, full long, hits long, no long, found array<string>, six array<string>"))
    labels = options.select(F.col("label").cast("string").alias("label"))
    if not parts:
        return labels.select("label", F.lit(False).alias("seen"), F.lit(None).cast("long").alias("ord"))
    flags = reduce(DataFrame.unionByName, parts).groupBy("label").agg(
        F.min("full").alias("full"), F.max(F.struct("hits", "no")).alias("m"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"), F.first("six").alias("six")
    )
    some = F.when(F.col("m.hits").isNotNull(), -F.col("m.no"))
    spread = (F.size("six") > 0) & (F.size(F.array_except("six", "found")) == 0)
    made = flags.select("label", (F.col("full").isNotNull() | some.isNotNull() | spread).alias("seen"), F.coalesce("full", some).alias("ord"))
    return labels.join(made, "label", "left").select("label", F.coalesce("seen", F.lit(False)).alias("seen"), "ord")


def av_matrix(options: DataFrame, slides: DataFrame, transcripts: DataFrame, relation: str = "both") -> DataFrame:
    """Seen and mentioned flags with the decision of the asked relation, and the slide and transcript that show it."""
    m = seen_in(options, slides).withColumnsRenamed({"seen": "visual", "ord": "slide"}).join(seen_in(options, transcripts).withColumnsRenamed({"seen": "audio", "ord": "transcript"}), "label")
    v, a = F.col("visual"), F.col("audio")
    if relation == "mentioned_not_visible":
        d = F.when(a & ~v, "match").otherwise("reject")
    elif relation == "visible_not_mentioned":
        d = F.when(v & ~a, "match").otherwise("reject")
    else:
        d = F.when(v & a, "match").otherwise("unknown")
    return m.withColumn("decision", d)


def best_rank(df: DataFrame, by: str, score: str, *tie) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), *tie)))
