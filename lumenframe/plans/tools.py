"""Tools of the question-answering agent as transformations of session rows.

A state row holds ``STATE``; every tool returns the rows with its columns renewed, so
many sessions take a step in one pass. ``search_*`` tools search an index or the video's
tables for all rows at once and merge their hits; ``retrieve_*`` merge hits that are columns
already. What a model would say comes in as a column as well (``lumenframe.udf``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mcq
from ..operators import search
from ..operators.textindex import TextIndex
from . import evidence as ev
from . import grounding, planner
from .predicates import has_temporal_candidates, is_audiovisual_question, is_negative_question, needs_slide

# fixed values: kinds of questions
QUESTION_TYPES = ("overview", "event_location", "temporal_order", "counting", "comparison", "visual_detail", "text_ocr", "existence", "general")
STATE = {
    "question": "string", "question_type": "string", "profile": "string", "frames": ev.FRAME, "scenes": ev.SCENE, "transcripts": ev.TEXT, "slides": ev.TEXT,
    "candidates": "array<struct<label: string, text: string, status: string, t: double, kind: string, marker: string, hits: int>>",
    "matrix": ev.MATRIX, "notes": ev.NOTE, "answer": "string",
    "duration": "double", "total_scenes": "int", "dense": "array<double>",
}


def state(rows: DataFrame) -> DataFrame:
    """Rows with every column of ``STATE``: those missing come as null, arrays as empty."""
    made = {c: F.lit(None).cast(t) for c, t in STATE.items() if c not in rows.columns}
    rows = rows.withColumns(made) if made else rows
    return rows.withColumns({c: ev.either(c, t) for c, t in STATE.items() if t.startswith("array")})


def choice(value: Column, known: tuple[str, ...], default: str) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*known), v).otherwise(F.lit(default))


def plan(rows: DataFrame, top_scenes: int = planner.TOP_SCENES, top_frames: int = planner.TOP_FRAMES) -> DataFrame:
    """Adds ``n_scenes`` and ``n_frames`` of the row's profile; unknown kinds and profiles fall back."""
    rows = rows.withColumn("question_type", choice(F.col("question_type"), QUESTION_TYPES, "general")).withColumn("profile", choice(F.col("profile"), planner.PROFILES, "balanced"))
    n, k = planner.retrieval_plan(F.col("profile"), F.lit(top_scenes), F.lit(top_frames))
    return rows.withColumn("n_scenes", n).withColumn("n_frames", k)


def tagged(times: Column, source: str, hypothesis: Column | None = None) -> Column:
    """Times as frames of a source."""
    h = hypothesis if hypothesis is not None else F.lit(None).cast("string")
    return F.transform(times, lambda t: F.struct(t.cast("double").alias("timestamp"), F.lit(source).alias("source"), h.alias("hypothesis")))


def retrieve_video(rows: DataFrame, frame_hits: str, scene_hits: str) -> DataFrame:
    """Merges hit times and scenes of a two-stage search."""
    return rows.withColumn("frames", ev.merge_frames("frames", tagged(F.col(frame_hits), "retrieval"))).withColumn("scenes", ev.merge_scenes("scenes", scene_hits))


def retrieve_hypothesis(rows: DataFrame, frame_hits: str, scene_hits: str, hypothesis: str) -> DataFrame:
    """The same for a search by question and hypothesis."""
    new = tagged(F.col(frame_hits), "hypothesis", F.col(hypothesis))
    return rows.withColumn("frames", ev.merge_frames("frames", new)).withColumn("scenes", ev.merge_scenes("scenes", scene_hits))


def hypothesis_query(question: Column, hypothesis: Column) -> Column:
    return F.concat_ws("\n", F.trim(question), F.trim(hypothesis))


def retrieve_texts(rows: DataFrame, kind: str, hits: str) -> DataFrame:
    """Merges text hits into ``transcripts`` or ``slides``."""
    return rows.withColumn(kind, ev.merge_texts(kind, hits))


def text_hits(rows: DataFrame, by: str, index: TextIndex, chunks: DataFrame, kind: str, k: int, dense: DataFrame | None = None, query: Column | None = None) -> DataFrame:
    """Rows with ``hits``: the best ``k`` chunks of the session's video for its question, as ``evidence.TEXT``.

    ``chunks`` has the index's owner columns and ``doc``, ``t_start``, ``t_end`` and ``text``. ``dense``, where given, is a second
    ranked list ``(by, doc, rank)``, such as ``VectorIndex.search_many`` makes; both are fused by reciprocal rank.
    One search serves all rows; what comes back are at most ``k`` rows a session.
    """
    asked = rows.select(F.col(by).alias("_by"), "video", F.lit(kind).alias("kind"), (query if query is not None else F.col("question")).alias("question"))
    found = index.search_many(asked, k if dense is None else 2 * k, "_by").select("_by", "doc", "rank")
    if dense is not None:
        found = search.rrf_many([found, dense.select(F.col(by).alias("_by"), "doc", "rank")], "_by", ["doc"], k)
    found = found.join(asked.select("_by", "video", "kind"), "_by").join(chunks, ["video", "kind", "doc"])
    item = F.struct("kind", F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end"), "text", (1.0 / (60 + F.col("rank"))).alias("score"))
    packed = found.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("h"))))["h"].alias("hits"))
    return rows.join(packed.withColumnRenamed("_by", by), by, "left").withColumn("hits", ev.either("hits", ev.TEXT))


def search_texts(rows: DataFrame, by: str, index: TextIndex, chunks: DataFrame, kind: str, k: int = 8, dense: DataFrame | None = None) -> DataFrame:
    """Searches transcripts or slides for every session and merges what it finds."""
    found = text_hits(rows, by, index, chunks, kind, k, dense)
    return retrieve_texts(found, "transcripts" if kind == "transcript" else "slides", "hits").drop("hits")


def search_keyword(rows: DataFrame, by: str, keyword: str, chunks: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` transcripts of every session's video that hold the keyword in the column ``keyword``, merged."""
    word = F.lower(F.trim(keyword))
    met = rows.select(F.col(by).alias("_by"), "video", word.alias("_w")).where("_w <> ''").join(chunks.where("kind = 'transcript'"), "video").where(F.contains(F.lower("text"), F.col("_w")))
    first = met.withColumn("rank", F.row_number().over(W.partitionBy("_by").orderBy("doc"))).where(F.col("rank") <= k)
    item = F.struct("kind", F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end"), "text", F.lit(1.0).alias("score"))
    packed = first.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("h"))))["h"].alias("_hits"))
    found = rows.join(packed.withColumnRenamed("_by", by), by, "left")
    return retrieve_texts(found, "transcripts", "_hits").drop("_hits")


def search_video(rows: DataFrame, by: str, scenes: DataFrame, frames: DataFrame, query: str = "query", hypothesis: str | None = None) -> DataFrame:
    """Two-stage search for every session: plans how much to take, finds scenes and frames of its video, merges both.

    ``query`` names the vector of the question, or of question and ``hypothesis`` where that column is given.
    """
    rows = plan(rows)
    gates, hits = search.two_stage_many(rows.select(F.col(by).alias("_by"), "video", query, "n_scenes", "n_frames"), scenes, frames, "_by", query=query)
    caption = F.col("caption") if "caption" in scenes.columns else F.lit(None).cast("string")
    named = gates.join(rows.select(F.col(by).alias("_by"), "video"), "_by").join(scenes.select("video", "start", "end", caption.alias("caption")), ["video", "start", "end"])
    scene = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "caption")
    s = named.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("rank", scene.alias("h"))))["h"].alias("_scenes"))
    f = hits.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("ts").alias("h"))))["h"].alias("_frames"))
    found = rows.join(s.withColumnRenamed("_by", by), by, "left").join(f.withColumnRenamed("_by", by), by, "left")
    found = found.withColumn("_frames", F.coalesce("_frames", F.array().cast("array<double>")))
    merged = retrieve_video(found, "_frames", "_scenes") if hypothesis is None else retrieve_hypothesis(found, "_frames", "_scenes", hypothesis)
    return merged.drop("_frames", "_scenes")


def align_audiovisual(rows: DataFrame, t: str, frames: str, transcripts: str, slides: str, radius: float = 4.0) -> DataFrame:
    """Merges frames, transcripts and slides around a time, and renews the matrix."""
    lo, hi = F.greatest(F.col(t) - radius, F.lit(0.0)), F.col(t) + radius
    near = lambda c: F.filter(F.col(c), lambda x: (x["t_start"] <= hi) & (x["t_end"] >= lo))
    at = F.filter(F.col(frames), lambda x: (x >= lo) & (x <= hi))
    rows = rows.withColumn("frames", ev.merge_frames("frames", tagged(at, "alignment")))
    rows = rows.withColumn("transcripts", ev.merge_texts("transcripts", near(transcripts))).withColumn("slides", ev.merge_texts("slides", near(slides)))
    return with_matrix(rows)


def with_matrix(rows: DataFrame) -> DataFrame:
    """Renews ``matrix`` from slides and transcripts."""
    none = ev.empty(ev.TEXT)
    seen, heard = ev.evidence_items(none, "slides", ev.empty(ev.SCENE)), ev.evidence_items("transcripts", none, ev.empty(ev.SCENE))
    return rows.withColumn("matrix", ev.audiovisual_matrix("question", mcq.options("question"), seen, heard))


def build_timeline(rows: DataFrame, window: float = 3.0, most: int = planner.MAX_FRAMES, expand: bool = True) -> DataFrame:
    """Adds dense frames around the evidence, and renews ``timeline``, ``candidates``, ``inferred_order`` and ``recommended_option``."""
    if expand:
        rows = expand_temporal(rows, window=window, most=most, source="timeline_expand")
    rows = rows.withColumn("timeline", ev.timeline("scenes", "frames"))
    rows = rows.withColumn("candidates", ev.candidate_rows(ev.timeline_candidates("question"), ev.evidence_items("transcripts", "slides", "scenes")))
    rows = rows.withColumn("inferred_order", ev.found_order(F.col("candidates")))
    return rows.withColumn("recommended_option", ev.timeline_option(F.col("candidates"), mcq.options("question")))


def expand_temporal(rows: DataFrame, targets: str | None = None, window: float = 4.0, most: int = planner.MAX_FRAMES, source: str = "temporal_expand") -> DataFrame:
    """Adds dense frames around the given times, or around those of the evidence."""
    own = F.transform("frames", lambda f: f["timestamp"])
    at = F.when(F.size(F.col(targets)) > 0, F.col(targets)).otherwise(own) if targets else own
    return rows.withColumn("frames", ev.merge_frames("frames", ev.dense_frames(F.col("dense"), at, window, most, source)))


def segment_focus(rows: DataFrame, center: str, half: str, observation: str) -> DataFrame:
    """Adds up to twelve frames of a window and a note of what was seen there; ``focus`` is the window."""
    rows = rows.withColumn("focus", ev.focus_window(F.col(center), F.col(half), F.col("duration")))
    mid, wide = (F.col("focus.start") + F.col("focus.end")) / 2.0, (F.col("focus.end") - F.col("focus.start")) / 2.0
    rows = rows.withColumn("_new", ev.dense_frames(F.col("dense"), F.array(mid), wide, ev.FOCUS_FRAMES, "segment_focus"))
    return noted(rows, "segment_focus", observation)


def stitched_verify(rows: DataFrame, windows: str, observation: str, fps: float = 1.0) -> DataFrame:
    """Adds up to 24 frames of up to four windows and a note; ``windows`` become ``window_frames`` with their counts."""
    normal, warning = ev.stitched_windows(F.col(windows))
    rows = rows.withColumn("_w", normal).withColumn("window_warning", warning)
    frames, counts = ev.stitched_frames(F.col("dense"), F.col("_w"), max(0.1, fps))
    rows = rows.withColumn("_new", frames).withColumn("window_frames", counts).drop("_w")
    return noted(rows, "stitched_verify", observation)


def noted(rows: DataFrame, tool: str, observation: str) -> DataFrame:
    """Merges ``_new`` frames with a note; without frames nothing is noted and ``required_next_action`` asks for retrieval."""
    some = F.size("_new") > 0
    note = ev.append_note("notes", F.lit(tool), F.col(observation), F.transform("_new", lambda f: f["timestamp"]))
    rows = rows.withColumn("notes", F.when(some, note).otherwise(F.col("notes")))
    rows = rows.withColumn("required_next_action", F.when(some, F.lit("answer_with_evidence")).otherwise(F.lit("retrieve_video_evidence")))
    return rows.withColumn("frames", ev.merge_frames("frames", "_new")).drop("_new")


def assess(rows: DataFrame) -> DataFrame:
    """Adds ``sufficient``, ``missing``, ``recommended_next_action`` and ``confidence`` from the state."""
    q, kind = F.coalesce("question", F.lit("")), F.coalesce("question_type", F.lit("general"))
    times, rows_c = F.transform("frames", lambda f: f["timestamp"]), F.col("candidates")
    av = is_audiovisual_question(q)
    facts = {
        "frames": F.size("frames"), "scenes": F.size("scenes"), "texts": F.size("transcripts") + F.size("slides"), "slides": F.size("slides"), "temporal": kind.isin(*planner.TEMPORAL_TYPES),
        "candidates": has_temporal_candidates(q), "timeline_rows": F.size(rows_c), "found_rows": F.size(F.filter(rows_c, lambda r: r["status"] == "found")),
        "options": F.size(mcq.options(q)) > 0, "resolved": ev.timeline_option(rows_c, mcq.options(q)).isNotNull(), "span": ev.span(times), "needs_slide": needs_slide(q, kind), "av": av,
        "av_rows": F.size("matrix"), "av_match": F.exists("matrix", lambda m: (m["decision"] == "match") & m["visual"]), "negative": is_negative_question(q, kind),
        "profile": F.coalesce("profile", F.lit("")), "total_scenes": F.coalesce("total_scenes", F.lit(0)),
    }
    # facts share names with columns of the state, so they are made inside a struct
    made = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*[v.alias(k) for k, v in facts.items()]).alias("_facts")).select("_row", "_facts.*")
    ok, missing, action, confidence = planner.sufficiency()
    return made.select("_row.*", ok.alias("sufficient"), missing.alias("missing"), action.alias("recommended_next_action"), confidence.alias("confidence"))


def ground(rows: DataFrame) -> DataFrame:
    """``grounding.grounding_report`` of the state's answer."""
    spans = lambda c: F.transform(c, lambda t: F.struct(t["t_start"].alias("t_start"), t["t_end"].alias("t_end")))
    option = ev.timeline_option(F.col("candidates"), mcq.options("question"))
    facts = {
        "question": F.col("question"), "question_type": F.col("question_type"), "profile": F.col("profile"), "answer": F.col("answer"), "frames": F.transform("frames", lambda f: f["timestamp"]),
        "transcripts": spans("transcripts"), "slides": spans("slides"), "recommended_label": option["label"],
        "matrix": F.transform("matrix", lambda m: F.struct(m["label"].alias("label"), m["decision"].alias("decision"))),
    }
    made = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*[v.alias(k) for k, v in facts.items()]).alias("_facts")).select("_row", "_facts.*")
    made = grounding.grounding_report(made)
    return made.select("_row.*", "warnings", "grounded", "next_action", "selected_label", "uncited", "invalid", "valid")


def valid_answer(answer: Column) -> Column:
    """Whether an answer says something and isn't cut inside a character."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    return (a != "") & ~a.endswith("\ufffd")


def answer(rows: DataFrame, said: str) -> DataFrame:
    """Takes a model's answer where it is valid, grounds it, and names an ``error`` where it isn't."""
    ok = valid_answer(F.col(said))
    rows = rows.withColumn("error", F.when(~ok, F.lit("empty_or_truncated_answer"))).withColumn("answer", F.when(ok, F.trim(said)).otherwise(F.col("answer")))
    return ground(rows)


def answer_prompt(rows: DataFrame) -> Column:
    """The question with its options, evidence lines, notes and the resolved option, for a model."""
    parts = [
        F.col("question"), F.when(F.size("transcripts") + F.size("slides") > 0, F.concat(F.lit("Evidence:\n"), ev.render_texts(ev.text_evidence("transcripts", "slides")))),
        F.when(F.size("notes") > 0, F.concat(F.lit("Notes:\n"), F.array_join(F.transform("notes", lambda n: n["observation"]), "\n"))),
        F.concat(F.lit("Order found: "), F.array_join(ev.found_order(F.col("candidates")), " ")), F.concat(F.lit("Resolved option: "), ev.timeline_option(F.col("candidates"), mcq.options("question"))["label"]),
        F.lit("Cite evidence by its markers."),
    ]
    return F.concat_ws("\n\n", *parts)


TOOLS = {
    "retrieve_video_evidence": search_video, "retrieve_transcript_evidence": search_texts, "search_transcript_keyword": search_keyword, "retrieve_slide_evidence": search_texts,
    "align_audiovisual_evidence": align_audiovisual, "build_timeline": build_timeline, "retrieve_hypothesis_evidence": search_video, "segment_focus": segment_focus,
    "expand_temporal_evidence": expand_temporal, "stitched_verify": stitched_verify, "assess_evidence_sufficiency": assess, "answer_with_evidence": answer, "verify_grounding": ground,
}
