"""Grounding of answers in evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mcq
from ..functions.markers import extract
from .predicates import claim_lines, guesses, has_scope, is_audiovisual_question, is_brand_question, is_negative_question, needs_slide, says_no

FRAME_TOLERANCE, TEXT_TOLERANCE = 0.65, 0.75
#: What the input of ``grounding_report`` may leave out.
OPTIONAL = {
    "question_type": "string", "profile": "string", "frames": "array<double>", "transcripts": "array<struct<t_start: double, t_end: double>>",
    "slides": "array<struct<t_start: double, t_end: double>>", "recommended_label": "string", "matrix": "array<struct<label: string, decision: string>>",
}


def uncited_claims(answer: Column) -> Column:
    """Claims whose line, and the ones beside it, hold no frame or slide marker."""
    lines = F.filter(F.transform(F.split(answer, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    near = F.transform(lines, lambda x, i: F.array_join(F.slice(lines, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), "\n"))
    visual = r"\[(FRAME|SLIDE):t=[0-9]"
    cited = lambda claim: claim.rlike(visual) | F.exists(F.zip_with(lines, near, lambda x, n: F.contains(x, claim) & n.rlike(visual)), lambda b: b)
    return F.filter(claim_lines(answer), lambda c: ~cited(c))


def invalid_markers(answer: Column, frames: Column, transcripts: Column, slides: Column) -> Column:
    """Markers that no evidence backs: frames within 0.65 s, transcripts by both ends, slides inside a span, within 0.75 s."""

    def backed(m):
        frame = F.exists(frames, lambda t: F.abs(t - m["t_start"]) <= FRAME_TOLERANCE)
        text = F.exists(transcripts, lambda s: (F.abs(s["t_start"] - m["t_start"]) <= TEXT_TOLERANCE) & (F.abs(s["t_end"] - m["t_end"]) <= TEXT_TOLERANCE))
        slide = F.exists(slides, lambda s: (m["t_start"] >= s["t_start"] - TEXT_TOLERANCE) & (m["t_start"] <= s["t_end"] + TEXT_TOLERANCE))
        return F.when(m["kind"] == "frame", frame).when(m["kind"] == "transcript", text).otherwise(slide)

    return F.filter(extract(answer), lambda m: ~backed(m))


def grounding_report(df: DataFrame) -> DataFrame:
    """Adds ``warnings``, ``grounded``, ``next_action``, ``selected_label``, ``uncited`` (five at most) and valid and invalid markers.

    Columns: question, answer and those of ``OPTIONAL``, which count as empty where they are missing or null.
    """
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns})
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    kind, profile = F.coalesce("question_type", F.lit("")), F.coalesce("profile", F.lit(""))
    times = [F.coalesce(c, F.array().cast(OPTIONAL[c])) for c in ("frames", "transcripts", "slides")]
    markers, opts = extract(a), mcq.options(q)
    work = df.withColumn("_q", q).withColumn("_a", a).withColumn("_bad", invalid_markers(a, *times)).withColumn("_all", markers).withColumn("_opts", opts)
    # what several rules read is bound once
    work = work.withColumn("selected_label", mcq.selected_label("_a", "_opts")).withColumn("_claims", claim_lines(F.col("_a"))).withColumn("_uncited", uncited_claims(F.col("_a")))
    q, a, opts, label = F.col("_q"), F.col("_a"), F.col("_opts"), F.col("selected_label")
    has = lambda of, kind: F.exists(of, lambda m: m["kind"] == kind)
    negative = ((profile == "negative_check") | is_negative_question(q, kind)) & says_no(a)
    slide = has("_all", "slide")
    visual = slide | has("_all", "frame")
    asks_slide = needs_slide(q, kind)
    ocr = asks_slide & ~slide & F.contains(F.lower(q), F.lit("ocr"))
    mcq_on = F.size(opts) > 0
    none = mcq_on & label.isNull()
    differs = mcq_on & label.isNotNull() & F.coalesce(label != F.col("recommended_label"), F.lit(False))
    clash = mcq_on & ~none & ~differs & mcq.option_contradiction(a, opts, label).isNotNull()
    weak = mcq_on & ~none & ~differs & ~clash & ~mcq.supports_option(a, mcq.option_of(label, opts)["text"])
    row = F.try_element_at(F.filter("matrix", lambda m: m["label"] == label), F.lit(1))
    rejected = is_audiovisual_question(q) & label.isNotNull() & F.coalesce(row["decision"] == "reject", F.lit(False))
    brand = is_brand_question(q) & guesses(a)
    uncited = F.col("_uncited")
    revise, again = "revise_answer_with_citations", "answer_with_evidence"
    rules = [
        ("invalid_frame_markers", has("_bad", "frame"), None),
        ("invalid_transcript_markers", has("_bad", "transcript"), None),
        ("invalid_slide_markers", has("_bad", "slide"), None),
        ("uncited_visual_claims", F.size(uncited) > 0, None),
        ("negative_without_check", negative & (profile != "negative_check"), "retrieve_video_evidence"),
        ("negative_without_scope", negative & ~has_scope(a), None),
        ("visual_claims_without_marker", (F.size("_claims") > 0) & ~visual, None),
        ("slide_marker_missing", ocr, None),
        ("visual_marker_missing", asks_slide & ~ocr & ~visual, None),
        ("no_candidate_selected", none, None),
        ("contradicts_recommended_option", differs, again),
        ("contradicts_selected_option", clash, again),
        ("weak_support_of_selected_option", weak, None),
        ("rejected_by_matrix", rejected, again),
        ("brand_guess_without_marker", brand & ~visual, revise),
        ("brand_guess_without_slide", brand & visual & ~slide & F.contains(F.lower(q), F.lit("brand")), revise),
    ]
    action = F.lit(revise)
    for _, fires, then in rules:
        if then:
            action = F.when(fires, F.lit(then)).otherwise(action)
    found = F.array_compact(F.array(*[F.when(fires, F.lit(name)) for name, fires, _ in rules]))
    out = work.withColumn("warnings", found).withColumn("_act", action).withColumn("uncited", F.slice(uncited, 1, 5))
    out = out.withColumn("grounded", F.size("warnings") == 0).withColumn("next_action", F.when(F.size("warnings") == 0, F.lit("final_answer")).otherwise(F.col("_act")))
    return out.withColumn("invalid", F.col("_bad")).withColumn("valid", F.size("_all") - F.size("_bad")).drop("_q", "_a", "_bad", "_all", "_opts", "_act", "_claims", "_uncited")
