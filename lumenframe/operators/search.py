"""Retrieval: keyword, BM25, exact cosine, fusion, coarse-to-fine."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..runtime import stored

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēėęěğģīįıķłļńņňőřśşšťţūůűųźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeeggiiikllnnnorsssttuuuuzzz"


def keyword_search(df: DataFrame, keyword: str, k: int, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first ``k`` rows in file order whose text holds the keyword, case folded; score 1."""
    kw = keyword.strip().lower()
    return df.where(F.contains(F.lower(text), F.lit(kw)) & F.lit(bool(kw))).orderBy(order).limit(k).withColumn("score", F.lit(1.0))


def like_fallback(df: DataFrame, query: str, k: int, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Substring match, ASCII case folded, rank 0."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.where(F.contains(low, F.lit(query.lower()))).orderBy(order).limit(k).withColumn("rank", F.lit(0.0))


def fold(c) -> F.Column:
    """Lower case without the accents of Latin letters; texts of ASCII alone are only lower-cased."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def terms_of(query: str, most: int = 12) -> list[list[str]]:
    """A question's terms: the first ``most`` between blanks without double quotes, each a phrase of its words."""
    folded = query.lower().translate(str.maketrans(ACCENTED, PLAIN))
    words = [re.findall(r"[^\W_]+", t.replace('"', "")) for t in folded.split()[:most]]
    return [list(w) for w in dict.fromkeys(map(tuple, filter(None, words)))]


def bm25(df: DataFrame, terms: list[str] | str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, bm25)`` of every row that holds a term. Statistics cover the whole table.

    ``terms`` is a question or a list of terms; a term of several words is a phrase.
    Rows that hold no term as a substring are only measured. What follows is narrow,
    so the single-row statistics are all that is broadcast. Counts are written once, as both
    the statistics and the scores read them: texts are cut once.
    """
    phrases = terms_of(terms) if isinstance(terms, str) else [w for t in dict.fromkeys(t.lower() for t in terms) for w in terms_of(t.replace(" ", "-"), 1)]
    if not phrases:
        return df.select(id_col, F.lit(0.0).alias("bm25")).where("false")
    # cut once: every token between two blanks, so a term is a substring with its blanks
    line = F.concat(F.lit(" "), F.regexp_replace(fold(F.col(text)), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    rows = df.select(F.col(id_col), line.alias("line"))
    blank = lambda c: F.length(c) - F.length(F.replace(c, F.lit("  "), F.lit(" ")))
    trimmed = F.trim("line")
    length = F.when(trimmed == "", 0).otherwise(blank(trimmed) + 1)

    def count(words: list[str]) -> F.Column:
        needle = " " + "  ".join(words) + " "
        n = (F.length("line") - F.length(F.replace("line", F.lit(needle), F.lit("")))) / len(needle)
        return F.when(F.contains("line", F.lit(needle)), n.cast("int")).otherwise(0)

    rows = stored(rows.select(id_col, length.alias("dl"), *[count(w).alias(f"f{i}") for i, w in enumerate(phrases)]), "bm25")
    many = range(len(phrases))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in many])
    score, hit = F.lit(0.0), F.lit(False)
    for i in many:
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
        hit = hit | (f > 0)
    return rows.where(hit).crossJoin(F.broadcast(stats)).select(id_col, score.alias("bm25"))


def top(df: DataFrame, score: str, k: int, *tie: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *tie).limit(k)


def dense(df: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """All rows with their exact cosine score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", cosine(vector, q))


def rrf(lists: list[DataFrame], keys: list[str], order: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of short ranked lists (columns: keys, ``score``, ``rank``).

    Sums ``1 / (c + rank)`` per key. The payload is the member with the highest raw
    score, the earlier list on a tie; output ties keep first-seen order.
    """
    tagged = [d.withColumn("src", F.lit(i)) for i, d in enumerate(lists)]
    both = tagged[0]
    for d in tagged[1:]:
        both = both.unionByName(d)
    seen = F.struct("src", "rank")
    last = F.struct((-F.col("src")).alias("src"), (-F.col("rank")).alias("rank"))
    fused = both.groupBy(*keys).agg(
        F.sum(1.0 / (c + F.col("rank"))).alias("rrf"), F.min(seen).alias("seen"), F.max(F.struct(F.col("score"), last.alias("s"), F.col(order).alias("payload")))["payload"].alias(order)
    )
    return fused.orderBy(F.col("rrf").desc(), "seen").limit(k)


def ranked(df: DataFrame, score: str, k: int, *tie: str) -> DataFrame:
    """The top ``k`` rows with 1-based ranks; ``k`` is small, so one task numbers them."""
    return top(df, score, k, *tie).withColumn("rank", F.row_number().over(W.orderBy(F.col(score).desc(), *tie)))


def scene_quota(k: int, has_ranges: bool) -> int:
    return max(1, k * 2 // 3) if has_ranges else k


def scene_share(k: Column, has_ranges: Column) -> Column:
    """``scene_quota`` for a column of limits."""
    return F.when(has_ranges, F.greatest(F.lit(1), F.floor(k * 2 / 3))).otherwise(k)


def two_stage(scenes: DataFrame, frames: DataFrame, query: list[float], n: int, k: int) -> DataFrame:
    """Top ``n`` scenes gate the frames; a share of ``k`` comes from gated frames, the rest from the global list.

    ``scenes(start, end, embedding)``, ``frames(ts, embedding)``. Gated frames come
    first; a timestamp counts once; the result is in time order.
    """
    gates = ranked(dense(scenes, query), "score", n, "start").select("start", "end")
    scored = dense(frames, query).select("ts", "score")
    gated = scored.join(F.broadcast(gates), (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end")), "left_semi")
    first = ranked(gated, "score", scene_quota(k, True), "ts").withColumn("tier", F.lit(0))
    # one frame a timestamp, so that equal ones don't use up the list
    rest = ranked(scored.groupBy("ts").agg(F.max("score").alias("score")), "score", 3 * k, "ts").withColumn("tier", F.lit(1))
    both = first.unionByName(rest)
    once = both.withColumn("r", F.row_number().over(W.partitionBy("ts").orderBy("tier", "rank"))).where("r = 1")
    return once.orderBy("tier", "rank").limit(k).select("ts", "score", "tier")


def rrf_many(lists: list[DataFrame], by: str, keys: list[str], k: int, c: int = 60) -> DataFrame:
    """Fusion for many questions: ``(by, keys, rrf, rank)``, the best ``k`` a question, from lists with ``by``, ``keys`` and ``rank``.

    Ties keep first-seen order, as in ``rrf``.
    """
    both = lists[0].select(by, *keys, "rank").withColumn("src", F.lit(0))
    for i, d in enumerate(lists[1:], 1):
        both = both.unionByName(d.select(by, *keys, "rank").withColumn("src", F.lit(i)))
    fused = both.groupBy(by, *keys).agg(F.sum(1.0 / (c + F.col("rank"))).alias("rrf"), F.min(F.struct("src", "rank")).alias("seen"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col("rrf").desc(), "seen", *keys))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).drop("seen")


def apart(spans: DataFrame, by: str) -> DataFrame:
    """The closed spans of each ``by`` joined where they meet, so that a point lies in one of them at most."""
    before = W.partitionBy(by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    new = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    run = F.sum("_new").over(W.partitionBy(by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0))
    joined = spans.where("start <= end").withColumn("_new", new).withColumn("_run", run).groupBy(by, "_run")
    return joined.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def two_stage_many(questions: DataFrame, scenes: DataFrame, frames: DataFrame, by: str = "question_id", owner: str = "video", query: str = "query") -> tuple[DataFrame, DataFrame]:
    """``two_stage`` for a table of questions: ``(by, start, end, score, rank)`` of their scenes, ``(by, ts, score, tier, rank)`` of their frames.

    ``questions`` has ``by``, ``owner``, ``query``, and ``n_scenes`` and ``n_frames``, how many each gets. Questions meet the
    scenes and frames of their owner in blocks (``nearest``), and only the best of a block move on; gated frames are those
    in the minutes of a question's scenes.
    """
    from .intervals import points_in_intervals
    from .nearest import best_in_pieces

    asked = questions.select(by, owner, F.col(query).alias("_q"), "n_scenes", "n_frames", (3 * F.col("n_frames")).alias("_most"))
    limits, nan = asked.select(by, "n_scenes", "n_frames"), float("nan")
    order = lambda *tie: F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), *tie))
    near = best_in_pieces(asked, scenes.select(owner, "start", "end", F.col("embedding").alias("_v")), owner, by, "_q", "n_scenes", "_v", ["start", "end"], odd=nan)
    gates = near.withColumn("rank", order("start", "end")).join(limits, by).where("rank <= n_scenes").select(by, "start", "end", "score", "rank")
    gates = stored(gates, "gates")  # read for the scenes and for the frames
    shots = frames.select(owner, "ts", F.col("embedding").alias("_v"))
    spans = apart(gates, by).join(asked.select(by, owner, "_q", "n_frames"), by)
    inside = points_in_intervals(shots, spans, owner, bucket=60.0)
    quota = scene_share(F.col("n_frames"), F.lit(True))
    first = inside.select(by, "n_frames", "ts", cosine("_v", "_q").alias("score")).withColumn("rank", order("ts")).where(F.col("rank") <= quota).withColumn("tier", F.lit(0))
    best = best_in_pieces(asked, shots, owner, by, "_q", "_most", "_v", ["ts"], once=True, odd=nan).groupBy(by, "ts").agg(F.max("score").alias("score"))
    rest = best.withColumn("rank", order("ts")).join(limits, by).where(F.col("rank") <= 3 * F.col("n_frames")).select(by, "n_frames", "ts", "score", "rank").withColumn("tier", F.lit(1))
    both = first.unionByName(rest).withColumn("r", F.row_number().over(W.partitionBy(by, "ts").orderBy("tier", "rank"))).where("r = 1")
    last = F.row_number().over(W.partitionBy(by).orderBy("tier", "rank"))
    return gates, both.withColumn("place", last).where("place <= n_frames").select(by, "ts", "score", "tier", F.col("place").alias("rank"))
