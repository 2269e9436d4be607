"""A full-text index in Parquet: postings by term bucket, replaced per owner, for one question or many.

Folder: ``postings/bucket=<n>`` has one row for each owner, document and term, with the positions of the term
and the length of the document; ``owners`` has one row for each time an owner (a video and a kind of
text) was written, with its counts. An owner's rows are those of its latest write. Its row in
``owners`` is written last, so a write that fails half-way is never seen, and readers see the state before.

What scales: a text becomes postings within its task, which writes its part of every bucket, so postings don't move; ``compact``
brings a bucket's parts together. A question reads the buckets of its words only, and of these the row groups whose
term range fits; positions are read for phrases only. Corpus counts are sums over ``owners``. A frequent
term's postings lie in the parts of all tasks (``SPREAD`` or more after ``compact``); when read they are joined by (term, owner) with
the words of many questions, never with each other. Hits of many questions are added up where a piece of an owner's documents
meets a block of its questions, and only a question's best leave the task.

Scores are those of ``search.bm25``: statistics cover the whole index, whatever owner is asked. A phrase
counts every place where its words follow each other. Documents are named within their owner;
writing an owner anew replaces all its documents.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..runtime import map_arrow, ship, slices, stored
from ..sources.files import exists
from .search import fold, terms_of

BUCKETS, SPREAD = 64, 8
WORD = r"[\p{L}\p{N}]+"
#: Words whose postings a task sorts, about 100 MB.
PART_WORDS = 1 << 20
#: Words whose postings a task of a write sorts.
TASK_WORDS = 1 << 22
#: Bytes of text that a task cuts at once.
PIECE = 2 << 20
#: Words of the documents, and terms of the questions, that meet in a group; what scores are whole numbers of as they add up (twelve terms stay far below 2048).
PIECE_WORDS, BLOCK, UNIT = 1 << 22, 1 << 20, 2.0**-52
#: Terms of all questions that are broadcast, about 15 MB.
FEW = 1 << 18


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def phrases_of(question: Column, most: int = 12) -> Column:
    """A question's terms as arrays of words, as ``search.terms_of`` has them, for a column of questions."""
    parts = F.slice(F.filter(F.split(fold(question), r"(?U)\s+"), lambda t: t != ""), 1, most)
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.regexp_extract_all(F.replace(t, F.lit('"'), F.lit("")), F.lit(WORD), 0)), lambda w: F.size(w) > 0))


def _idf(n: Column, total: Column) -> Column:
    return F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(1e-6))


def _score(f: Column, n: Column, dl: Column, total: Column, mean: Column) -> Column:
    return _idf(n, total) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))


def inverted(lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Row, term and places of every term of every line of words between blanks, by term: alike rows lie together and pack well."""
    words = pc.split_pattern(lines, " ")
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])][: len(row)])
    places = pa.ListArray.from_arrays(pa.array(np.r_[head, len(row)].astype(np.int32)), pa.array(at[order]))
    return pa.array(row[head]), coded.dictionary.take(pa.array(code[head])), places


class TextIndex:
    """The index in ``path``; ``owner`` names the columns that a write replaces, ``doc`` a document within them."""

    def __init__(self, spark: SparkSession, path: str, owner: tuple[str, ...] = ("video", "kind"), doc: str = "doc", buckets: int = BUCKETS):
        self.spark, self.path, self.owner, self.doc, self.buckets = spark, path, list(owner), doc, buckets

    def write(self, chunks: DataFrame, text: str = "text") -> None:
        """Replace every owner that ``chunks`` holds by its rows there."""
        gen = time.time_ns()
        rows = self._lines(chunks, text)
        counts = stored(rows.groupBy(*self.owner).agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("words")), "counts")
        words = counts.agg(F.sum("words")).first()[0] or 0
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-words // TASK_WORDS))
        terms = self._terms(rows.coalesce(tasks)).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        # each task writes its own part of every bucket: postings are larger than their texts and never move
        dealt = terms.sortWithinPartitions("bucket", "term").withColumn("count", F.size("places")).withColumn("gen", F.lit(gen))
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        self._commit(counts, gen)

    def _spread(self, words: int) -> int:
        """Parts of a bucket, so that a task sorts about ``PART_WORDS`` words in memory."""
        return max(SPREAD, -(-words // (self.buckets * PART_WORDS)))

    def _lines(self, chunks: DataFrame, text: str) -> DataFrame:
        """``(owner, doc, line, length)``: the words of every text between blanks, and their number."""
        line = F.trim(F.regexp_replace(fold(F.col(text)), r"[^\p{L}\p{N}]+", " "))
        blanks = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
        return chunks.select(*self.owner, self.doc, line.alias("line")).withColumn("length", F.when(F.col("line") == "", 0).otherwise(blanks + 1))

    def _terms(self, rows: DataFrame) -> DataFrame:
        """``(owner, doc, length, term, places)`` of such rows, made where they are: a document's words never move apart."""
        key = [*self.owner, self.doc, "length"]

        def run(batches):
            for b in batches:
                sizes = pc.binary_length(b.column(len(key))).to_numpy(zero_copy_only=False)
                for lo, hi in slices(sizes, PIECE):
                    part = b.slice(lo, hi - lo)
                    row, term, places = inverted(part.column(len(key)))
                    yield pa.RecordBatch.from_arrays([*[part.column(i).take(row) for i in range(len(key))], term, places], names=[*key, "term", "places"])

        kept = rows.select(*key, "line")
        schema = StructType([*[StructField(f.name, f.dataType) for f in kept.schema.fields[:-1]], StructField("term", StringType()), StructField("places", ArrayType(IntegerType()))])
        return map_arrow(kept.where("line <> ''"), run, schema)

    def remove(self, owners: DataFrame) -> None:
        """Drop all documents of these owners."""
        none = F.lit(0).cast("long")
        self._commit(owners.select(*self.owner).distinct().withColumn("docs", none).withColumn("words", none), time.time_ns())

    def _commit(self, rows: DataFrame, gen: int) -> None:
        rows.withColumn("gen", F.lit(gen)).coalesce(1).write.mode("append").parquet(f"{self.path}/owners")

    def owners(self) -> DataFrame:
        """``(owner, gen, docs, words)`` of the latest write of every owner."""
        latest = F.max_by(F.struct("gen", "docs", "words"), "gen").alias("s")
        return self.spark.read.parquet(f"{self.path}/owners").groupBy(*self.owner).agg(latest).select(*self.owner, "s.*").where("docs > 0")

    def postings(self) -> DataFrame:
        """Rows of latest writes; filters on ``bucket`` and ``term`` reach the files."""
        # the statistics below count on owners without null names: a null owner joins nothing
        return self.spark.read.parquet(f"{self.path}/postings").join(self.owners().select(*self.owner, "gen"), [*self.owner, "gen"], "left_semi")

    def empty(self) -> bool:
        return not exists(self.spark, f"{self.path}/postings")

    def compact(self, path: str) -> TextIndex:
        """A copy without replaced rows."""
        spread = self._spread(self.owners().agg(F.sum("words")).first()[0] or 0)
        to = (F.col("bucket"), F.pmod(F.xxhash64(self.doc), F.lit(spread)))
        dealt = self.postings().repartition(self.buckets * spread, *to) if spread > SPREAD else self.postings().repartition(*to)
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.owners().write.parquet(f"{path}/owners")
        return TextIndex(self.spark, path, tuple(self.owner), self.doc, self.buckets)

    def corpus(self) -> DataFrame:
        """One row: number of documents and mean length."""
        return self.owners().agg(F.sum("docs").alias("total"), (F.sum("words") / F.sum("docs")).alias("mean"))

    def bm25(self, question: str, where: Column | None = None) -> DataFrame:
        """``(owner, doc, bm25)`` of the documents that hold a term of one question, of those owners only for which ``where`` holds."""
        phrases = terms_of(question)
        words = sorted({w for p in phrases for w in p})
        key = [*self.owner, self.doc]
        if not phrases or self.empty():
            nothing = ", ".join(f"{c} string" for c in key) if self.empty() else None
            rows = self.spark.createDataFrame([], nothing) if nothing else self.postings().select(*key).where("false")
            return rows.withColumn("bm25", F.lit(0.0))
        asked = [(F.col("bucket") == bucket_of(F.lit(w), self.buckets)) & (F.col("term") == w) for w in words]
        any_ = asked[0]
        for a in asked[1:]:
            any_ = any_ | a
        long_ = {w for p in phrases if len(p) > 1 for w in p}
        held = lambda w, c: F.max(F.when(F.col("term") == w, F.col(c))).alias(f"{c}_{words.index(w)}")
        rows = self.postings().where(any_).groupBy(*key).agg(F.max("length").alias("length"), *[held(w, "count") for w in words], *[held(w, "places") for w in sorted(long_)])
        place = lambda w: F.col(f"places_{words.index(w)}")

        def times(p: list[str]) -> Column:
            if len(p) == 1:
                return F.coalesce(F.col(f"count_{words.index(p[0])}"), F.lit(0))

            def follows(x: Column) -> Column:
                ok = F.lit(True)
                for i, w in enumerate(p[1:], 1):
                    ok = ok & F.array_contains(place(w), x + i)
                return ok

            return F.greatest(F.size(F.filter(place(p[0]), follows)), F.lit(0))

        some = range(len(phrases))
        rows = rows.select(*key, "length", *[times(p).alias(f"f{i}") for i, p in enumerate(phrases)])
        stats = rows.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in some]).crossJoin(self.corpus())  # two single rows
        hit, score = F.lit(False), F.lit(0.0)
        for i in some:
            hit = hit | (F.col(f"f{i}") > 0)
            score = score + _score(F.col(f"f{i}"), F.col(f"n{i}"), F.col("length"), F.col("total"), F.col("mean"))
        rows = rows.where(hit if where is None else hit & where)
        return rows.crossJoin(F.broadcast(stats)).select(*key, score.alias("bm25"))

    def search(self, question: str, k: int, where: Column | None = None) -> DataFrame:
        """The best ``k`` documents with their ``score`` 1 / (1 + bm25)."""
        return self.bm25(question, where).orderBy(F.col("bm25").desc(), self.doc).limit(k).withColumn("score", 1 / (1 + F.abs("bm25")))

    def search_many(self, questions: DataFrame, k: int, by: str = "question_id", text: str = "question") -> DataFrame:
        """``(by, owner, doc, bm25, rank)``: the best ``k`` documents of every question's owner.

        ``questions`` has ``by``, ``text`` and those columns of ``owner`` that it is limited to. Words are matched once
        for all questions that share them; a question meets only documents of its owner that hold one of its terms.
        """
        limits = [c for c in self.owner if c in questions.columns]
        asked = questions.select(by, *limits, F.explode(phrases_of(F.col(text))).alias("phrase"))
        # written first: small tables whose size is known meet the postings where these lie
        asked = stored(asked.withColumn("term", F.array_join("phrase", " ")), "asked")
        # what all questions ask for, once: at most twelve terms a question
        phrases = stored(asked.select("phrase", F.col("term").alias("asked")).distinct(), "phrases")
        words = phrases.where(F.size("phrase") > 1).select("asked", F.size("phrase").alias("n_words"), F.posexplode("phrase").alias("no", "term"))
        words = words.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        one = phrases.where(F.size("phrase") == 1).select("asked", F.col("asked").alias("term"), bucket_of(F.col("asked"), self.buckets).alias("bucket"))
        if phrases.count() <= FEW:  # then postings stay where they lie, whatever the session's own limit
            one, words = F.broadcast(one), F.broadcast(words)
        # pieces and blocks (below) come with the owners, which the postings meet anyway
        sizes = stored(self._sizes(asked, limits), "sizes")
        key, carried = [*self.owner, self.doc], ["_pieces", "_blocks"]
        posts = self.spark.read.parquet(f"{self.path}/postings").join(sizes, [*self.owner, "gen"])
        single = posts.join(one, ["bucket", "term"]).select("asked", *key, *carried, "length", F.col("count").alias("f"))
        starts = posts.join(words, ["bucket", "term"]).select("asked", "n_words", *key, *carried, "length", F.explode(F.transform("places", lambda x: x - F.col("no"))).alias("start"), "no")
        whole = starts.groupBy("asked", "n_words", *key, *carried, "length", "start").agg(F.count_distinct("no").alias("met")).where("met = n_words")
        multi = whole.groupBy("asked", *key, *carried, "length").agg(F.count(F.lit(1)).cast("int").alias("f"))
        found = single.unionByName(multi)
        counts = found.groupBy("asked").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(self.corpus()))
        mine = asked.select(by, *limits, F.col("term").alias("asked")).join(counts.select("asked", "mean", _idf(F.col("n"), F.col("total")).alias("idf")), "asked")
        mine = mine.groupBy(by, *limits).agg(F.collect_list(F.struct("asked", "idf")).alias("_terms"), F.first("mean").alias("_mean"))
        per_limit = sizes.select(*limits, *carried).distinct()
        mine = mine.join(per_limit, limits) if limits else mine.crossJoin(F.broadcast(per_limit))
        best = self._best_in_pieces(mine, found, limits, k, by)
        rank = F.row_number().over(W.partitionBy(by).orderBy(F.col("bm25").desc(), self.doc))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)

    def _sizes(self, asked: DataFrame, limits: list[str]) -> DataFrame:
        """``(owner, gen, _pieces, _blocks)``: of about ``PIECE_WORDS`` words and ``BLOCK`` terms asked; blocks are null where nothing is asked."""
        owners = self.owners()
        parts = lambda df, n, most, name: (df.groupBy(*limits) if limits else df).agg(F.greatest(F.ceil(n / most), F.lit(1)).cast("int").alias(name))
        pieces, blocks = parts(owners, F.sum("words"), PIECE_WORDS, "_pieces"), parts(asked, F.count(F.lit(1)), BLOCK, "_blocks")
        both = pieces.join(blocks, limits, "left") if limits else pieces.crossJoin(blocks)
        rows = owners.select(*self.owner, "gen")
        return rows.join(both, limits) if limits else rows.crossJoin(F.broadcast(both))

    def _best_in_pieces(self, mine: DataFrame, found: DataFrame, limits: list[str], k: int, by: str) -> DataFrame:
        """``(by, owner, doc, bm25)``: of every piece of the documents each question's best ``k``.

        The documents that a question is limited to are dealt into pieces, such questions into blocks. A group is one piece with
        one block, so a question's hits never leave their task, and its memory doesn't grow with the index.
        """
        ship(self.spark)
        group, key = [*limits, "_piece", "_block"], [*self.owner, self.doc]
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
        held = found.where("_blocks is not null").select(*key, dealt("_pieces", *key).alias("_piece"), each("_blocks").alias("_block"), F.col("asked").alias("_asked"), F.col("f").alias("_f"), F.col("length").alias("_dl"))
        wanted = mine.where("_blocks is not null").select(*limits, each("_pieces").alias("_piece"), dealt("_blocks", by).alias("_block"), F.col(by).alias("_by"), F.col("_terms.asked").alias("_asked"), F.col("_terms.idf").alias("_idf"), "_mean")
        schema = StructType([StructField(by, mine.schema[by].dataType), *[found.schema[c] for c in key], StructField("bm25", DoubleType())])

        def cut(rows: pa.Table, asked: pa.Table) -> pa.Table:
            at, row, score = best_hits(rows, asked, key, k)
            return pa.table([asked["_by"].take(at), *[rows[c].take(row) for c in key], score], names=[by, *key, "bm25"])

        return held.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInArrow(cut, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    a = column.combine_chunks()
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def places_of(rows: pa.Table, key: list[str]) -> np.ndarray:
    """A number for each row's document, in the order of the last column of ``key`` and then of the others."""
    place = np.zeros(len(rows), np.int64)
    for c in (key[-1], *key[:-1]):
        coded = _whole(rows[c]).dictionary_encode()
        rank = np.empty(len(coded.dictionary) + 1, np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank))
        rank[-1] = 0
        codes = rank[coded.indices.fill_null(len(rank) - 1).to_numpy()]
        place = np.unique(place * len(rank) + codes, return_inverse=True)[1]
    return place


def best_hits(rows: pa.Table, asked: pa.Table, key: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of questions, of one row of each of their best ``k`` documents, and the scores.

    Scores of terms add up as whole numbers of ``UNIT``: the same sum in any order, so documents of equal terms tie and come by their names.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(rows) or not len(asked):
        return none
    place = places_of(rows, key)
    first = np.unique(place, return_index=True)[1]
    coded = _whole(rows["_asked"]).dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary) + 1))
    at, f, dl, mean = place[order], *(rows[c].to_numpy()[order].astype(np.float64) for c in ("_f", "_dl")), asked["_mean"][0].as_py()
    weight = f + 1.2 * (0.25 + 0.75 * dl / mean)
    lists = _whole(asked["_asked"])
    ends, code = lists.offsets.to_numpy(), pc.index_in(lists.values, coded.dictionary).fill_null(-1).to_numpy()
    idf = _whole(asked["_idf"]).values.to_numpy()
    added, kept, out = np.zeros(len(first), np.int64), {}, []
    points: dict[int, np.ndarray] = {}

    def of(t: int, x: float) -> np.ndarray:
        if t not in points:
            s = slice(starts[t], starts[t + 1])
            points[t] = np.maximum(np.rint(x * f[s] * 2.2 / weight[s] / UNIT).astype(np.int64), 1)
        return points[t]

    for q in range(len(asked)):
        some = slice(ends[q], ends[q + 1])
        terms = [(t, x) for t, x in zip(code[some].tolist(), idf[some].tolist(), strict=True) if t >= 0]
        name = tuple(sorted(t for t, _ in terms))
        if name not in kept:  # the same question is answered once
            for t, x in terms:
                added[at[starts[t] : starts[t + 1]]] += of(t, x)
            hit = np.flatnonzero(added)
            score = added[hit]
            if len(hit) > k:
                near = score >= np.partition(score, len(hit) - k)[len(hit) - k]
                hit, score = hit[near], score[near]
            top = np.argsort(-score, kind="stable")[:k]
            kept[name] = first[hit[top]], score[top] * UNIT
            added.fill(0)
        out.append((np.full(len(kept[name][0]), q), *kept[name]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))
