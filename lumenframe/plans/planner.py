"""Retrieval plans, sufficiency rules and run-time guards, with rules as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits of the planner and its defaults
MAX_SCENES, MAX_FRAMES = 12, 36
TOP_SCENES, TOP_FRAMES = 5, 12
MAX_CALLS = 8
PROFILES = ("focused", "balanced", "broad", "temporal", "detail", "negative_check")
TEMPORAL_TYPES = ("temporal_order", "counting", "comparison")


def retrieval_plan(profile: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """``(scenes, frames)`` of a profile; unknown profiles count as balanced."""
    n2 = F.when(profile == "focused", F.least(n, F.lit(3))).when(profile.isin("broad", "temporal"), n * 2).when(profile == "negative_check", n * 3).otherwise(n)
    k2 = (
        F.when(profile == "focused", F.least(k, F.lit(8))).when(profile.isin("broad", "detail", "negative_check"), k * 2)
        .when(profile == "temporal", F.greatest(k, F.floor(k * 1.5).cast("int"))).otherwise(k)
    )
    return F.greatest(F.lit(1), F.least(n2, F.lit(MAX_SCENES))), F.greatest(F.lit(1), F.least(k2, F.lit(MAX_FRAMES)))


def sufficiency_rules() -> list[tuple[str, Column, str]]:
    """``(missing, condition, next action)`` in order, over the columns of an evidence summary.

    Columns: frames, scenes, texts, slides, temporal, candidates, timeline_rows, found_rows, options,
    resolved, span, needs_slide, av, av_rows, av_match, negative, profile, total_scenes.
    """
    c = F.col
    t, tl = c("temporal"), c("timeline_rows")
    return [
        ("evidence", (c("frames") == 0) & (c("texts") == 0), "retrieve_video_evidence"),
        ("scenes", (c("scenes") == 0) & (c("texts") == 0), "retrieve_video_evidence"),
        ("timeline", t & c("candidates") & (tl == 0), "build_timeline"),
        ("candidate_hits", t & c("candidates") & (tl > 0) & (c("found_rows") < tl), "search_transcript_keyword"),
        ("resolved_option", t & c("candidates") & (tl > 0) & (c("found_rows") == tl) & c("options") & ~c("resolved"), "build_timeline"),
        ("temporal_frames", t & (c("frames") < min(8, MAX_FRAMES)), "build_timeline"),
        ("temporal_span", t & (c("span") < 1.0), "expand_temporal_evidence"),
        ("slides", c("needs_slide") & (c("slides") == 0), "retrieve_slide_evidence"),
        ("av_matrix", c("av") & (c("av_rows") == 0), "align_audiovisual_evidence"),
        ("av_match", c("av") & (c("av_rows") > 0) & ~c("av_match"), "retrieve_slide_evidence"),
        ("negative_profile", c("negative") & (c("profile") != "negative_check"), "retrieve_video_evidence"),
        ("negative_scenes", c("negative") & (c("scenes") < F.least(F.when(c("total_scenes") > 0, c("total_scenes")).otherwise(12), F.lit(max(2 * TOP_SCENES, 6)))), "retrieve_video_evidence"),
        ("negative_frames", c("negative") & (c("frames") < min(MAX_FRAMES, max(2 * TOP_FRAMES, 12))), "retrieve_video_evidence"),
    ]


def sufficiency() -> tuple[Column, Column, Column, Column]:
    """``(sufficient, missing, next action, confidence)``; missing rules gather, the last one names the action."""
    action, missing = F.lit("answer_with_evidence"), []
    for name, fires, then in sufficiency_rules():
        action = F.when(fires, F.lit(then)).otherwise(action)
        missing.append(F.when(fires, F.lit(name)))
    gone = F.array_compact(F.array(*missing))
    ok = F.size(gone) == 0
    return ok, gone, action, F.when(ok, F.lit(0.78)).otherwise(F.lit(0.35))


def guard() -> Column:
    """The step that run-time guards force, in order of priority.

    Columns: calls, stalled, grounded, unverified, reanswer, answerable.
    """
    c = F.col
    steps = [(c("calls") >= MAX_CALLS, "cap"), (c("stalled"), "stalled"), (c("grounded"), "final"), (c("unverified"), "verify"), (c("reanswer"), "reanswer"), (c("answerable"), "answer")]
    out = F.lit("plan")
    for cond, step in reversed(steps):
        out = F.when(cond, F.lit(step)).otherwise(out)
    return out


def video_profile() -> tuple[Column, ...]:
    """Per-minute densities and the class, from duration, scenes, segments, slides, ocr_chars, has_transcript, has_slides.

    All null where the duration is below one second.
    """
    c, m = F.col, F.col("duration") / 60.0
    live = c("duration") >= 1.0
    slides = F.when(c("has_slides"), c("slides")).otherwise(0) / m
    ocr = F.when(c("has_slides") & (c("slides") > 0), c("ocr_chars")).otherwise(0) / m
    segments, scenes = F.when(c("has_transcript"), c("segments")).otherwise(0) / m, c("scenes") / m
    kind = (
        F.when((slides >= 2.0) & (ocr >= 100), "slide_heavy")
        .when(c("has_transcript") & (slides < 1.0) & (segments >= 5.0), "speech_heavy")
        .when((slides < 0.5) & (~c("has_transcript") | (segments < 2.0)) & (scenes >= 3.0), "visual_dynamic")
        .otherwise("mixed")
    )
    made = (F.round(scenes, 2), F.round(segments, 2), F.round(slides, 2), F.round(ocr, 1), kind)
    return tuple(F.when(live, x) for x in made)
