"""Converters from question sets to evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import parsing
from .functions.mcq import format_question
from .functions.text import answer_keywords


def benchmark_cases(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cases of rows ``question_id, videoID, question, options, answer, task_type``; left out without a video or with a letter out of range."""
    at = F.ascii(F.upper(F.trim("answer"))) - F.ascii(F.lit("A"))
    made = rows.join(manifest.withColumnsRenamed({"video": "videoID"}), "videoID").withColumn("_o", F.when(at >= 0, F.try_element_at("options", at + 1))).where("_o is not null")
    mode = parsing.modality("task_type")
    return made.select(
        F.concat(F.lit("vme-"), "question_id").alias("case_id"), "video_id", parsing.question_with_options("question", "options").alias("question"), mode.alias("modality_tag"),
        F.lower("task_type").alias("question_type"), parsing.option_keywords("_o").alias("expected_keywords"), F.lit(1).alias("expected_citation_min"),
        parsing.expected_kinds(F.col("task_type"), mode).alias("expected_citation_kinds"), parsing.option_text("_o").alias("reference_answer"),
    )


def frequent_videos(rows: DataFrame, video: str, least: int, most: int) -> DataFrame:
    """The ``most`` videos with at least ``least`` questions, by count, then name."""
    counts = rows.groupBy(video).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.col("n").desc(), video).limit(most)


def first_successes(tried: DataFrame, order: str, ok: str, tries: int, wanted: int) -> DataFrame:
    """The first ``wanted`` successes among the first ``tries`` attempts."""
    return tried.orderBy(order).limit(tries).where(ok).orderBy(order).limit(wanted)


def new_cases(rows: DataFrame, existing: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows whose key isn't there yet, each once."""
    return rows.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def long_video_cases(rows: DataFrame) -> DataFrame:
    """Rows of ``id, question, candidates, correct_choice, video_path, duration``; a choice out of range is invalid."""
    d = F.col("duration")
    answer = F.try_element_at("candidates", F.col("correct_choice") + 1)
    bucket = F.when(d <= 60, "short").when(d <= 600, "medium").otherwise("long")
    made = rows.select(
        F.concat(F.lit("longvideo-"), "id").alias("case_id"), format_question("question", "candidates").alias("question"), answer.alias("reference_answer"),
        answer_keywords(answer).alias("required_keywords"), bucket.alias("bucket"), "video_path",
    )
    return made.where(F.col("reference_answer").isNotNull())


def interval_cases(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Cases of rows ``video_id, qid, type, question, answer, a0..a4`` with gold intervals ``(video_id, qid, spans)``, if any.

    A row without id, video, question or answer is invalid. Spans below two ends are left out.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    spans = F.filter(F.coalesce("spans", F.array().cast("array<array<double>>")), lambda s: F.size(s) >= 2)
    scenes = F.transform(spans, lambda s: F.struct(F.least(s[0], s[1]).alias("start"), F.greatest(s[0], s[1]).alias("end")))
    made = rows.where(full("qid") & full("video_id") & full("question") & full("answer")).join(intervals, ["video_id", "qid"], "left").withColumn("gold_scenes", scenes)
    return made.select(
        F.concat_ws("-", F.lit("interval"), "video_id", "qid").alias("case_id"), format_question("question", F.array(*[F.coalesce(f"a{i}", F.lit("")) for i in range(5)])).alias("question"),
        F.col("answer").alias("reference_answer"), answer_keywords("answer").alias("required_keywords"), F.transform("gold_scenes", lambda s: (s["start"] + s["end"]) / 2).alias("gold_timestamps"),
        "gold_scenes", F.when(F.col("type").isin("TN", "TC", "TP"), "build_timeline").alias("expected_action"),
    )


def first_cases(cases: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` cases in file order; all where ``n`` is None or not positive."""
    return cases.orderBy(order).limit(n) if n is not None and n > 0 else cases
