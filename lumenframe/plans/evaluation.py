"""Evaluation of predictions against cases: parsing, gates, failure tags, summaries.

A case and its prediction are one row; gold times, hits and citations are short
arrays in it, so every gate is a column expression and a run is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mcq
from ..functions.markers import extract, frame_times
from .predicates import is_brand_guess, is_comparison_case, is_temporal_case, is_uncertain

TOLERANCE, CITATION_TOLERANCE = 2.0, 0.65
# fixed values: citation kinds and their other names
KINDS = {
    "frame": "frame", "frames": "frame", "visual": "frame", "frame_or_slide": "frame_or_slide", "visual_evidence": "frame_or_slide", "transcript": "transcript",
    "transcripts": "transcript", "audio": "transcript", "speech": "transcript", "slide": "slide", "slides": "slide", "ppt": "slide", "ocr": "slide",
}
EXPANSION = ("expand_temporal_evidence", "build_timeline", "retrieve_hypothesis_evidence")
RETRIEVAL = (
    "retrieve_video_evidence", "retrieve_transcript_evidence", "search_transcript_keyword", "retrieve_slide_evidence", "align_audiovisual_evidence", "build_timeline",
    "retrieve_hypothesis_evidence", "segment_focus", "expand_temporal_evidence", "stitched_verify",
)
SPANS = "array<struct<start: double, end: double>>"
CASE = (
    "case_id string, question_id string, video_id string, question string, gold_timestamps array<double>, gold_scenes array<struct<start: double, end: double>>, reference_answer string, "
    "required_keywords array<string>, expected_keywords array<string>, forbidden_keywords array<string>, expected_action string, requires_uncertainty boolean, needs_expansion boolean, "
    "modality_tag string, question_type string, expected_citation_min int, expected_citation_kinds string"
)
PREDICTION = (
    "case_id string, retrieved_timestamps array<double>, scene_hits array<struct<start: double, end: double>>, retrieved_transcripts array<struct<t_start: double, t_end: double, text: string>>, "
    "retrieved_slides array<struct<t_start: double, t_end: double, text: string>>, answer string, agent_actions array<string>, "
    "evidence_sufficiency struct<sufficient: boolean, recommended_next_action: string>"
)


def citation_kinds(c) -> Column:
    """Kinds by their common names, once each in order; unknown ones are left out. Takes an array of strings."""
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    known = F.filter(F.transform(c, lambda k: F.lower(F.trim(k))), lambda k: k.isin(*KINDS))
    return F.array_distinct(F.transform(known, lambda k: F.element_at(names, k)))


def parse_cases(raw: DataFrame, json: str = "value") -> DataFrame:
    """Cases of JSON lines, with the other names and defaults of their fields. A case without id or question raises."""
    c = raw.select(F.from_json(json, CASE).alias("c")).select("c.*")
    no = lambda n, t: F.coalesce(n, F.array().cast(t))
    listed = F.coalesce(F.from_json("expected_citation_kinds", "array<string>"), F.split(F.coalesce("expected_citation_kinds", F.lit("")), ","))
    kinds, expected = citation_kinds(listed), no("expected_keywords", "array<string>")
    required = no("required_keywords", "array<string>")
    case_id = F.coalesce(F.when(F.col("case_id") != "", F.col("case_id")), "question_id")
    tag = lambda n: F.lower(F.trim(F.coalesce(n, F.lit(""))))
    return c.select(
        F.when(case_id.isNull() | (case_id == ""), F.raise_error(F.lit("case_id"))).otherwise(case_id).alias("case_id"), F.coalesce("video_id", F.lit("")).alias("video_id"),
        F.when(F.col("question").isNull(), F.raise_error(F.lit("question"))).otherwise(F.col("question")).alias("question"),
        no("gold_timestamps", "array<double>").alias("gold_timestamps"), no("gold_scenes", SPANS).alias("gold_scenes"), F.coalesce("reference_answer", F.lit("")).alias("reference_answer"),
        F.when(F.size(required) > 0, required).otherwise(expected).alias("required_keywords"), no("forbidden_keywords", "array<string>").alias("forbidden_keywords"), "expected_action",
        F.coalesce("requires_uncertainty", F.lit(False)).alias("requires_uncertainty"), F.coalesce("needs_expansion", F.lit(False)).alias("needs_expansion"),
        tag("modality_tag").alias("modality_tag"), tag("question_type").alias("question_type"), expected.alias("expected_keywords"),
        F.coalesce("expected_citation_min", F.when(F.size(kinds) > 0, 1)).alias("expected_citation_min"), kinds.alias("expected_citation_kinds"),
    )


def parse_predictions(raw: DataFrame, json: str = "value", order: str = "pos") -> DataFrame:
    """Predictions of JSON lines; of a case's several the last one counts."""
    p = raw.select(F.from_json(json, PREDICTION).alias("p"), order).where(F.col("p.case_id").isNotNull())
    p = p.groupBy(F.col("p.case_id").alias("case_id")).agg(F.max_by("p", order).alias("p")).select("p.*")
    no = lambda n: F.coalesce(n, F.array().cast(p.schema[n].dataType)).alias(n)
    arrays = [no(f.name) for f in p.schema.fields if f.dataType.typeName() == "array"]
    rest = [F.coalesce("answer", F.lit("")).alias("answer"), F.col("evidence_sufficiency")]
    hits = F.filter(F.coalesce("scene_hits", F.array().cast(SPANS)), lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return p.select("case_id", *[a for a in arrays], *rest).withColumn("scene_hits", hits)


def nearest_distance(t: Column, times: Column) -> Column:
    """The least distance to any of the times; null if there are none."""
    return F.array_min(F.transform(times, lambda x: F.abs(x - t)))


def ratio(flags: Column) -> Column:
    """Share of true flags; null without flags."""
    return F.when(F.size(flags) > 0, F.size(F.filter(flags, lambda f: f)) / F.size(flags))


def scene_accuracy(gold: Column, hits: Column) -> Column:
    """Share of gold scenes that overlap a hit, ends included."""
    return ratio(F.transform(gold, lambda g: F.exists(hits, lambda h: F.greatest(g["start"], h["start"]) <= F.least(g["end"], h["end"]))))


def retrieval_section(gold: Column, times: Column, gold_scenes: Column, hits: Column, tolerance: float = TOLERANCE, recall_k: int | None = None) -> Column:
    """``struct<passed, recall, distance, scene_accuracy>``; ``passed`` is null without any gold."""
    times = F.slice(times, 1, recall_k) if recall_k else times
    near = F.transform(gold, lambda g: nearest_distance(g, times))
    recall = ratio(F.transform(near, lambda d: F.coalesce(d <= tolerance, F.lit(False))))
    known = F.filter(near, lambda d: d.isNotNull())
    distance = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, d: s + d) / F.size(known))
    accuracy = scene_accuracy(gold_scenes, hits)
    passed = F.coalesce(recall >= 1.0, F.lit(True)) & F.coalesce(accuracy >= 1.0, F.lit(True))
    return F.struct(F.when(recall.isNotNull() | accuracy.isNotNull(), passed).alias("passed"), recall.alias("recall"), distance.alias("distance"), accuracy.alias("scene_accuracy"))


def _answer(answer: Column, wanted: Column, forbidden: Column, citations: Column, coverage: Column, needs_doubt: Column) -> Column:
    low = F.lower(answer)
    answered = (F.trim(answer) != "") & F.forall(wanted, lambda k: F.contains(low, F.lower(k)))
    free = ~F.exists(forbidden, lambda k: F.contains(low, F.lower(k)))
    sure = ~needs_doubt | is_uncertain(answer)
    return F.struct(
        (answered & free & citations & sure).alias("passed"), answered.alias("answered"), free.alias("hallucination_free"), citations.alias("citation_correct"),
        sure.alias("uncertainty_ok"), coverage.alias("coverage"),
    )


def answer_section(answer: Column, times: Column, required: Column, forbidden: Column, needs_doubt: Column) -> Column:
    """Keywords all there, none forbidden, frame markers within 0.65 s of evidence (none without evidence), doubt where it is due."""
    markers = frame_times(answer)
    near = F.forall(markers, lambda t: F.coalesce(nearest_distance(t, times) <= CITATION_TOLERANCE, F.lit(False)))
    cited = F.when(F.size(times) > 0, (F.size(markers) > 0) & near).otherwise(F.size(markers) == 0)
    return _answer(answer, required, forbidden, cited, F.lit(None).cast("map<string, boolean>"), needs_doubt)


def audiovisual_section(answer: Column, expected: Column, forbidden: Column, least: Column, kinds: Column, needs_doubt: Column) -> Column:
    """Like ``answer_section``, with enough markers and one of every expected kind in place of distances."""
    markers = extract(answer)
    has = lambda k: F.exists(markers, lambda m: (m["kind"] == k) | ((k == "frame_or_slide") & m["kind"].isin("frame", "slide")))
    covered = F.transform(kinds, has)
    cited = (F.size(markers) >= F.greatest(F.lit(0), F.coalesce(least, F.lit(0)))) & F.forall(covered, lambda c: c)
    return _answer(answer, expected, forbidden, cited, F.map_from_arrays(kinds, covered), needs_doubt)


def agent_section(actions: Column, expected: Column, needs_expansion: Column, sufficiency: Column) -> Column:
    """``struct<passed, expected_action_ok, expansion_ok, sufficiency_checked>``."""
    wants = F.coalesce(expected != "", F.lit(False))
    expected_ok = ~wants | F.array_contains(actions, F.coalesce(expected, F.lit("")))
    expansion_ok = ~needs_expansion | F.arrays_overlap(actions, F.array(*map(F.lit, EXPANSION)))
    given = sufficiency.isNotNull()
    checked = ~(wants | needs_expansion | given) | F.array_contains(actions, "assess_evidence_sufficiency") | given
    then = F.coalesce(sufficiency["recommended_next_action"], F.lit(""))
    followed = F.coalesce(sufficiency["sufficient"], F.lit(True)) | (then == "") | F.array_contains(actions, then)
    ok = checked & followed
    return F.struct((expected_ok & expansion_ok & ok).alias("passed"), expected_ok.alias("expected_action_ok"), expansion_ok.alias("expansion_ok"), ok.alias("sufficiency_checked"))


def retrieves_after_answer(actions: Column) -> Column:
    at = F.array_position(actions, "answer_with_evidence").cast("int")
    rest = F.when(at > 0, F.slice(actions, at + 1, F.greatest(F.size(actions) - at, F.lit(0))))
    return F.coalesce(F.arrays_overlap(rest, F.array(*map(F.lit, RETRIEVAL))), F.lit(False))


def case_gate(retrieval: Column, answer: Column, agent: Column, judge: Column, free: Column, sure: Column) -> Column:
    """A judge's yes waives retrieval, keywords, citations and the agent gate, never hallucination or uncertainty."""
    ok = F.coalesce(judge, F.lit(False))
    strict = F.coalesce(retrieval, F.lit(True)) & answer & F.coalesce(agent, F.lit(True))
    return F.when(ok, free & sure).otherwise(strict)


def sorted_tags(flags: dict[str, Column]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in flags.items()]))))


def failure_tags(question: Column, kind: Column, answer: Column, actions: Column, section: Column, retrieval: Column, agent: Column, judge: Column, passed: Column, opts: Column, label: Column) -> Column:
    """The sorted reasons why a case failed; none if it passed. ``judge`` is the judge's verdict, null without one."""
    waived = F.coalesce(judge, F.lit(False))
    temporal, brand = is_temporal_case(question, kind), is_brand_guess(question, answer)
    wrong = (F.size(opts) > 0) & (label.isNull() | F.coalesce(~judge, F.lit(False)))
    missing = lambda k: F.coalesce(~F.try_element_at(section["coverage"], F.lit(k)), F.lit(False))
    tags = sorted_tags({
        "no_final_answer": F.trim(answer) == "", "missing_expected_keyword": ~section["answered"], "missing_citation_kind": ~section["citation_correct"],
        "missing_slide": missing("slide"), "missing_frame_or_slide": missing("frame_or_slide"), "temporal_order_error": temporal,
        "audiovisual_comparison_error": is_comparison_case(question), "wrong_temporal_option": wrong & temporal, "unsupported_visual_brand_guess": wrong & ~temporal & brand,
        "wrong_fact_option": wrong & ~temporal & ~brand, "post_answer_retrieval": retrieves_after_answer(actions),
        "agent_loop_issue": ~agent["passed"] & ~waived, "retrieval_issue": F.coalesce(~retrieval["passed"], F.lit(False)) & ~waived,
    })
    return F.when(passed, F.array().cast("array<string>")).otherwise(tags)


def is_audiovisual_case() -> Column:
    c = F.col
    return (c("modality_tag") != "") | (F.size("expected_keywords") > 0) | (F.size("expected_citation_kinds") > 0) | c("expected_citation_min").isNotNull()


def evaluate_cases(rows: DataFrame, judge: str | None = None, tolerance: float = TOLERANCE, recall_k: int | None = None) -> DataFrame:
    """Adds retrieval, answer_section, agent, passed, failure_tags, selected_option and recommended_option.

    ``rows`` has the columns of a case and of its prediction (``parse_cases`` joined with
    ``parse_predictions``); ``judge`` names a column with a judge's verdict, null where it gave none.
    """
    c = F.col
    verdict = c(judge) if judge else F.lit(None).cast("boolean")
    expected = F.when(F.size("expected_keywords") > 0, c("expected_keywords")).otherwise(c("required_keywords"))
    plain = answer_section(c("answer"), c("retrieved_timestamps"), c("required_keywords"), c("forbidden_keywords"), c("requires_uncertainty"))
    both = audiovisual_section(c("answer"), expected, c("forbidden_keywords"), c("expected_citation_min"), c("expected_citation_kinds"), c("requires_uncertainty"))
    out = rows.withColumn("retrieval", retrieval_section(c("gold_timestamps"), c("retrieved_timestamps"), c("gold_scenes"), c("scene_hits"), tolerance, recall_k))
    out = out.withColumn("answer_section", F.when(is_audiovisual_case(), both).otherwise(plain))
    out = out.withColumn("agent", agent_section(c("agent_actions"), c("expected_action"), c("needs_expansion"), c("evidence_sufficiency")))
    s, opts = c("answer_section"), c("options")
    out = out.withColumn("options", mcq.options("question")).withColumn("selected_label", mcq.selected_label("answer", "options"))
    out = out.withColumn("passed", case_gate(c("retrieval.passed"), s["passed"], c("agent.passed"), verdict, s["hallucination_free"], s["uncertainty_ok"]))
    tags = failure_tags(c("question"), c("question_type"), c("answer"), c("agent_actions"), s, c("retrieval"), c("agent"), verdict, c("passed"), opts, c("selected_label"))
    out = out.withColumn("failure_tags", tags).withColumn("selected_option", mcq.option_of(c("selected_label"), opts))
    return out.withColumn("recommended_option", mcq.recommended_option("reference_answer", "options")).drop("options", "selected_label")


def evaluate_answer(df: DataFrame) -> DataFrame:
    """Adds answered, hallucination_free, citation_correct, uncertainty_ok and answer_passed.

    Columns: answer, required and forbidden keywords, requires_uncertainty, frames (evidence times).
    """
    made = answer_section(F.col("answer"), F.col("frames"), F.col("required"), F.col("forbidden"), F.col("requires_uncertainty"))
    out = df.withColumn("_s", made)
    names = ("answered", "hallucination_free", "citation_correct", "uncertainty_ok")
    return out.select("*", *[F.col(f"_s.{n}") for n in names], F.col("_s.passed").alias("answer_passed")).drop("_s")


def evaluate_retrieval(gold: DataFrame, found: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """``(key, recall, mean_distance, passed)`` of long tables of gold and found times; cases without gold have no row."""
    from ..operators.intervals import nearest

    n = nearest(gold, found, key)
    hit = F.coalesce((F.col("distance") <= tolerance).cast("double"), F.lit(0.0))
    out = n.groupBy(key).agg(F.avg(hit).alias("recall"), F.avg("distance").alias("mean_distance"))
    return out.withColumn("passed", F.col("recall") == 1.0)


def case_group(case_id: Column) -> Column:
    """The prefix before the first dash; ``misc`` if empty."""
    p = F.split_part(case_id, F.lit("-"), F.lit(1))
    return F.when(p == "", F.lit("misc")).otherwise(p)


def summarize(results: DataFrame, group: str) -> DataFrame:
    """Counts and rates by group with a total row (group null): passed, judge_score and sections with null for n/a."""
    return results.rollup(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.coalesce(F.round(F.count_if("passed") / F.count(F.lit(1)), 6), F.lit(0.0)).alias("pass_rate"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("section_passed").cast("double")), 6).alias("section_rate"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row a group of ``evaluate_cases`` and one for all (group null): counts, section rates, mean recall, distance and scene accuracy."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return results.withColumn("group", case_group(F.col("case_id"))).rollup("group").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), rate("passed").alias("pass_rate"), rate("answer_section.passed").alias("answer_rate"),
        rate("agent.passed").alias("agent_rate"), rate("retrieval.passed").alias("retrieval_rate"), rate("retrieval.recall").alias("mean_recall"),
        rate("retrieval.distance").alias("mean_distance"), rate("retrieval.scene_accuracy").alias("mean_scene_accuracy"),
    )


def tag_counts(results: DataFrame) -> DataFrame:
    """``(tag, n)`` by count, then name."""
    return results.select(F.explode("failure_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag")


def worst(results: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` failed cases in input order."""
    return results.where(~F.col("passed")).orderBy(order).limit(n)


def judge_rate(results: DataFrame, verdict: str) -> DataFrame:
    """Share of yes among the judge's verdicts; null without any."""
    return results.agg(F.try_divide(F.count_if(verdict), F.count(verdict)).alias("judge_rate"))


def report(results: DataFrame, missing: DataFrame | None = None, order: str = "case_id", n: int = 10) -> str:
    """A Markdown report of small aggregates: groups, tags, the first failures, missing cases."""
    show = lambda v: "-" if v is None else f"{v:.3f}"
    lines = ["# Evaluation", "", "| Group | Cases | Passed | Rate | Answer | Agent | Retrieval |", "|---|---|---|---|---|---|---|"]
    for r in sorted(summary(results).collect(), key=lambda r: (r["group"] is not None, r["group"] or "")):
        lines.append("| " + " | ".join([r["group"] or "all", str(r["total"]), str(r["passed"]), *(show(r[c]) for c in ("pass_rate", "answer_rate", "agent_rate", "retrieval_rate"))]) + " |")
    lines += ["", "## Failure tags", ""] + [f"- {r['tag']}: {r['n']}" for r in tag_counts(results).collect()]
    lines += ["", "## First failures", ""] + [f"- {r['case_id']}: {', '.join(r['failure_tags'])}" for r in worst(results, order, n).select("case_id", "failure_tags").collect()]
    if missing is not None:
        gone = missing.select("case_id").orderBy("case_id").limit(n + 1).collect()
        lines += ["", "## Missing predictions", ""] + [f"- {r['case_id']}" for r in gone[:n]] + (["- and more"] if len(gone) > n else [])
    return "\n".join(lines) + "\n"


def exit_code(pass_rate: float | None, fail_under: float, missing: int) -> int:
    """2 where predictions are missing, 1 where the rate is below the bar, else 0."""
    return 2 if missing else int((pass_rate or 0.0) < fail_under)


def run_meta(cases: DataFrame, results: DataFrame, models: dict[str, str], fingerprint: str, version: str, dataset: str = "custom", path: str = "", n: int | None = None, tolerance: float = 3.0, recall_k: int = 5, judged: bool = False) -> dict:
    """What a report says about its run: data, counts, models (``vlm``, ``orchestrator``), fingerprint and settings."""
    vlm = models.get("vlm", "")
    return {
        "dataset": dataset, "dataset_path": path, "n": n, "n_cases_total": cases.count(), "n_cases_predicted": results.count(), "vlm_model_name": vlm,
        "orchestrator_model_name": models.get("orchestrator") or vlm, "prompt_fingerprint": fingerprint, "agent_code_version": version, "tolerance_sec": tolerance, "recall_k": recall_k, "judge_enabled": judged,
    }


def join_predictions(cases: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with their prediction, and cases without one."""
    return cases.join(predictions, "case_id"), cases.join(predictions, "case_id", "left_anti")


def modality_tally(cases: DataFrame, column: str = "modality_tag") -> DataFrame:
    return cases.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def judge_json(c: Column) -> Column:
    """``struct<correct, score, justification, error>`` of a judge's reply: fences and chatter around the object are left out."""
    text = F.trim(F.coalesce(c, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^`+(?i:json)?", ""), r"`+$", ""))
    body = F.when(bare.startswith("{"), bare).otherwise(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    # truth by the object's own rules: numbers but zero, words, lists and objects count as true
    fields = F.from_json(body, "map<string,string>")
    raw, score = F.trim(F.try_element_at(fields, F.lit("correct"))), F.trim(F.get_json_object(body, "$.score"))
    correct = raw.isNotNull() & ~raw.isin("false", "0", "0.0", "", "[]", "{}", "null")
    quoted = body.rlike(r'"score"\s*:\s*"')
    bad = fields.isNull()
    return F.struct(
        (correct & ~bad).alias("correct"), F.when(~bad & ~quoted, score.try_cast("double")).alias("score"),
        F.when(bad, F.substring(F.coalesce(c, F.lit("")), 1, 200)).otherwise(F.coalesce(F.try_element_at(fields, F.lit("justification")), F.lit(""))).alias("justification"),
        F.when(bad, F.lit("json")).alias("error"),
    )

