"""Evaluation, planning and grounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mcq
from ..operators import sampling
from ..plans import evaluation, grounding, planner, predicates
from .registry import query, read, read_even
from .texts import ANSWER, answers


@query("eval_summary_by_group", """WITH j AS (SELECT source, quality, toxic, d.doc_id FROM documents d JOIN labels l USING (doc_id))
SELECT source, count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS passed, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*), 6) AS pass_rate, round(avg(doc_id % 5), 6) AS mean_score,
 round(avg(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS section_rate FROM j GROUP BY ROLLUP (source)""")
def summary(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    r = j.select("source", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), (F.col("doc_id") % 5).alias("score"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 0).alias("section_passed"))
    return evaluation.summarize(r, "source")


@query("answer_eval", f"""WITH a AS (SELECT conv_id, turn, {ANSWER} AS answer FROM conversations), s AS (SELECT conv_id, turn, contains(lower(answer), 'saw') AND contains(lower(answer), 'the') AS answered, NOT contains(lower(answer), 'ention') AS hallucination_free,
 list_bool_or(list_transform([10.0, 20.4, 35.2], lambda e: abs(e - conv_id % 60) <= 0.65)) AS citation_correct, turn % 2 = 0 OR regexp_matches(lower(answer), '{"|".join(predicates.UNCERTAINTY).replace("'", "''")}') AS uncertainty_ok FROM a)
SELECT *, answered AND hallucination_free AND citation_correct AND uncertainty_ok AS answer_passed FROM s""")
def answer_eval(spark, sf):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    a = answers(spark, sf).withColumn("required", arr("saw", "The")).withColumn("forbidden", arr("Ention")).withColumn("requires_uncertainty", F.col("turn") % 2 != 0).withColumn("frames", arr(10.0, 20.4, 35.2))
    return evaluation.evaluate_answer(a).select("conv_id", "turn", "answered", "hallucination_free", "citation_correct", "uncertainty_ok", "answer_passed")


QUESTIONS = ("In what order are they listed?", "Which brand is recommended?", "What is shown in the video and mentioned in the audio?", "What happens?")
OPTIONS = "\n\nCandidates:\nA) red car\nB) blue boat\n\nAnswer the question"


def cases(spark, sf, audiovisual: bool = False):
    """A case and its prediction for every labelled document, over its whole text."""
    i = F.col("doc_id")
    d = read_even(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    ask = F.element_at(F.array(*map(F.lit, QUESTIONS)), (i % 4 + 1).cast("int"))
    said = F.concat(F.coalesce("text", F.lit("")), F.when(i % 2 == 0, F.concat(F.lit(" [FRAME:t="), (i % 50).cast("string"), F.lit(".0]"))).otherwise(""), F.when(i % 5 == 0, " Answer: B) it is").otherwise(""))
    span = lambda a, b: F.array(F.struct(a.cast("double").alias("start"), b.cast("double").alias("end")))
    none = lambda t: F.array().cast(t)
    words = lambda *x: F.array(*map(F.lit, x)) if x else none("array<string>")
    return d.select(
        "doc_id", F.concat_ws("-", "source", i.cast("string")).alias("case_id"), F.concat(ask, F.when(i % 3 == 0, OPTIONS).otherwise("")).alias("question"), F.when(i % 11 == 0, "").otherwise(said).alias("answer"),
        F.when(i % 3 == 1, none("array<double>")).otherwise(F.array((i % 100).cast("double"))).alias("gold_timestamps"), F.array((i % 97).cast("double"), F.lit(50.0)).alias("retrieved_timestamps"),
        F.when(i % 7 == 0, span(F.lit(10), F.lit(20))).otherwise(none(evaluation.SPANS)).alias("gold_scenes"), span(i % 30, i % 30 + 5).alias("scene_hits"), F.when(i % 4 == 0, "blue boat.").otherwise("").alias("reference_answer"),
        words("the").alias("required_keywords"), words("ention").alias("forbidden_keywords"), (words("the") if audiovisual else words()).alias("expected_keywords"), F.when(i % 2 == 0, "build_timeline").alias("expected_action"),
        (i % 9 == 0).alias("requires_uncertainty"), (i % 6 == 0).alias("needs_expansion"), F.lit("joint" if audiovisual else "").alias("modality_tag"), F.lit("general").alias("question_type"),
        F.lit(2 if audiovisual else None).cast("int").alias("expected_citation_min"), (words("frame_or_slide", "slide") if audiovisual else words()).alias("expected_citation_kinds"),
        F.concat(words("retrieve_video_evidence", "answer_with_evidence"), F.when(F.col("quality") == 0, words("build_timeline")).otherwise(words())).alias("agent_actions"),
        F.when(i % 4 == 0, F.struct((F.col("toxic") == 0).alias("sufficient"), F.lit("build_timeline").alias("recommended_next_action"))).alias("evidence_sufficiency"), F.when(i % 5 == 0, F.col("quality") == 1).alias("judge"),
    )


_DOUBT = "|".join(predicates.UNCERTAINTY).replace("'", "''")
_OPTIONS_SQL = OPTIONS.replace("\n", "' || chr(10) || '")


def _cases_sql(audiovisual: bool) -> str:
    ask = " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(QUESTIONS))
    if audiovisual:
        cited = "len(regexp_extract_all(answer, '\\[(FRAME|SLIDE):t=[0-9]+(\\.[0-9]+)?\\]|\\[TRANSCRIPT:t=[0-9.]+-[0-9.]+\\]')) >= 2 AND (marks > 0 OR slides > 0) AND slides > 0"
        cover = "slides = 0 AS no_slide, marks = 0 AND slides = 0 AS no_visual"
    else:
        cited = "marks > 0 AND len(list_filter(list_transform(regexp_extract_all(answer, '\\[FRAME:t=([0-9]+(?:\\.[0-9]+)?)\\]', 1), lambda x: x::DOUBLE), lambda t: least(abs(t - doc_id % 97), abs(t - 50)) > 0.65)) = 0"
        cover = "false AS no_slide, false AS no_visual"
    return f"""d AS (SELECT doc_id, source || '-' || doc_id AS case_id, quality, toxic, CASE doc_id % 4 {ask} END AS ask, doc_id % 3 = 0 AS has_options,
 CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' [FRAME:t=' || doc_id % 50 || '.0]' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' Answer: B) it is' ELSE '' END END AS answer FROM documents JOIN labels USING (doc_id)),
m AS (SELECT *, len(regexp_extract_all(answer, '\\[FRAME:t=[0-9]+(\\.[0-9]+)?\\]')) AS marks, len(regexp_extract_all(answer, '\\[SLIDE:t=[0-9]+(\\.[0-9]+)?\\]')) AS slides,
 upper(regexp_extract(answer, '(?i)\\b(?:answer|correct answer|选项|答案)\\s*[:：]?\\s*\\**([A-E])\\**\\s*[).]', 1)) AS explicit, regexp_extract(answer, '\\b([A-E])\\s*[).]\\s+', 1) AS bare, trim(regexp_replace(lower(answer), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')) AS norm FROM d),
s AS (SELECT *, {cover}, CASE WHEN has_options THEN CASE WHEN explicit <> '' THEN CASE WHEN explicit IN ('A', 'B') THEN explicit END WHEN bare <> '' THEN CASE WHEN bare IN ('A', 'B') THEN bare END WHEN contains(norm, 'red car') THEN 'A' WHEN contains(norm, 'blue boat') THEN 'B' END END AS selected,
 CASE WHEN doc_id % 3 <> 1 THEN CASE WHEN least(abs(doc_id % 100 - doc_id % 97), abs(doc_id % 100 - 50)) <= 2 THEN 1.0 ELSE 0.0 END END AS recall, CASE WHEN doc_id % 3 <> 1 THEN least(abs(doc_id % 100 - doc_id % 97), abs(doc_id % 100 - 50))::DOUBLE END AS distance,
 CASE WHEN doc_id % 7 = 0 THEN CASE WHEN greatest(10, doc_id % 30) <= least(20, doc_id % 30 + 5) THEN 1.0 ELSE 0.0 END END AS scenes,
 trim(answer) <> '' AND contains(lower(answer), 'the') AS answered, NOT contains(lower(answer), 'ention') AS free_, {cited} AS cited, doc_id % 9 <> 0 OR regexp_matches(lower(answer), '{_DOUBT}') AS sure,
 doc_id % 2 <> 0 OR quality = 0 AS expected_ok, doc_id % 6 <> 0 OR quality = 0 AS expansion_ok, CASE WHEN doc_id % 4 = 0 THEN toxic = 0 OR quality = 0 ELSE doc_id % 2 <> 0 AND doc_id % 6 <> 0 END AS checked, CASE WHEN doc_id % 5 = 0 THEN quality = 1 END AS judge FROM m),
g AS (SELECT *, CASE WHEN recall IS NOT NULL OR scenes IS NOT NULL THEN coalesce(recall >= 1, true) AND coalesce(scenes >= 1, true) END AS retrieval, answered AND free_ AND cited AND sure AS answer_ok, expected_ok AND expansion_ok AND checked AS agent FROM s),
p AS (SELECT *, CASE WHEN coalesce(judge, false) THEN free_ AND sure ELSE coalesce(retrieval, true) AND answer_ok AND agent END AS passed, doc_id % 4 = 0 AS temporal,
 doc_id % 4 = 1 AND regexp_matches(lower(answer), 'widely recognized|typical|characteristic|least implausible|standard product') AS brand, has_options AND (selected IS NULL OR coalesce(NOT judge, false)) AS wrong FROM g),
r AS (SELECT *, CASE WHEN passed THEN [] ELSE list_sort(list_filter([CASE WHEN trim(answer) = '' THEN 'no_final_answer' END, CASE WHEN NOT answered THEN 'missing_expected_keyword' END, CASE WHEN NOT cited THEN 'missing_citation_kind' END,
 CASE WHEN no_slide THEN 'missing_slide' END, CASE WHEN no_visual THEN 'missing_frame_or_slide' END, CASE WHEN temporal THEN 'temporal_order_error' END, CASE WHEN doc_id % 4 = 2 THEN 'audiovisual_comparison_error' END, CASE WHEN wrong AND temporal THEN 'wrong_temporal_option' END,
 CASE WHEN wrong AND NOT temporal AND brand THEN 'unsupported_visual_brand_guess' END, CASE WHEN wrong AND NOT temporal AND NOT brand THEN 'wrong_fact_option' END, CASE WHEN quality = 0 THEN 'post_answer_retrieval' END,
 CASE WHEN NOT agent AND NOT coalesce(judge, false) THEN 'agent_loop_issue' END, CASE WHEN NOT retrieval AND NOT coalesce(judge, false) THEN 'retrieval_issue' END], lambda x: x IS NOT NULL)) END AS tags FROM p)"""


_CASE_SQL = "SELECT case_id, retrieval, recall::DOUBLE AS recall, distance, scenes::DOUBLE AS scene_accuracy, answered, free_ AS hallucination_free, cited AS citation_correct, sure AS uncertainty_ok, agent, passed, array_to_string(tags, ',') AS tags, selected, CASE WHEN has_options AND doc_id % 4 = 0 THEN 'B' END AS recommended FROM r"


def evaluated(rows):
    a = F.col("answer_section")
    return rows.select(
        "case_id", F.col("retrieval.passed").alias("retrieval"), "retrieval.recall", "retrieval.distance", "retrieval.scene_accuracy", a["answered"].alias("answered"), a["hallucination_free"].alias("hallucination_free"),
        a["citation_correct"].alias("citation_correct"), a["uncertainty_ok"].alias("uncertainty_ok"), F.col("agent.passed").alias("agent"), "passed", F.array_join("failure_tags", ",").alias("tags"),
        F.col("selected_option.label").alias("selected"), F.col("recommended_option.label").alias("recommended"),
    )


@query("evaluate_case", f"WITH {_cases_sql(False)} {_CASE_SQL}")
def evaluate_case(spark, sf):
    return evaluated(evaluation.evaluate_cases(cases(spark, sf), "judge"))


@query("audiovisual_eval", f"WITH {_cases_sql(True)} {_CASE_SQL}")
def audiovisual_eval(spark, sf):
    return evaluated(evaluation.evaluate_cases(cases(spark, sf, True), "judge"))


@query("failure_tag_counts", f"WITH {_cases_sql(True)} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM r) GROUP BY tag")
def tags(spark, sf):
    return evaluation.tag_counts(evaluation.evaluate_cases(cases(spark, sf, True), "judge"))


@query("eval_report", f"""WITH {_cases_sql(False)}, x AS (SELECT *, CASE WHEN split_part(case_id, '-', 1) = '' THEN 'misc' ELSE split_part(case_id, '-', 1) END AS grp FROM r)
SELECT grp AS "group", count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 6) AS pass_rate, round(avg(answer_ok_2::INT), 6) AS answer_rate, round(avg(agent::INT), 6) AS agent_rate, round(avg(retrieval::INT), 6) AS retrieval_rate,
 round(avg(recall), 6) AS mean_recall, round(avg(distance), 6) AS mean_distance, round(avg(scenes), 6) AS mean_scene_accuracy FROM (SELECT *, answer_ok AS answer_ok_2 FROM x) GROUP BY ROLLUP (grp)""")
def report(spark, sf):
    return evaluation.summary(evaluation.evaluate_cases(cases(spark, sf), "judge"))


@query("judge_rate", "SELECT count(*) FILTER (doc_id % 5 = 0 AND quality = 1) / count(*) FILTER (doc_id % 5 = 0) AS judge_rate FROM labels")
def judge_rate(spark, sf):
    verdict = F.when(F.col("doc_id") % 5 == 0, F.col("quality") == 1)
    return evaluation.judge_rate(read(spark, sf, "labels").withColumn("judge", verdict), "judge")


@query("modality_tally", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def tally(spark, sf):
    return evaluation.modality_tally(read(spark, sf, "documents"), "lang")


@query("citation_counts", f"""SELECT conv_id, turn, (length({ANSWER}) - length(replace({ANSWER}, '[FRAME:', ''))) // 7 AS frame, (length({ANSWER}) - length(replace({ANSWER}, '[TRANSCRIPT:', ''))) // 12 AS transcript,
 (length({ANSWER}) - length(replace({ANSWER}, '[SLIDE:', ''))) // 7 AS slide, contains({ANSWER}, '[FRAME:') OR contains({ANSWER}, '[SLIDE:') AS frame_or_slide FROM conversations""")
def citation_counts(spark, sf):
    from ..functions.markers import extract

    a = answers(spark, sf).withColumn("m", extract("answer"))
    count = lambda k: F.size(F.filter("m", lambda m: m["kind"] == k)).cast("long").alias(k)
    return a.select("conv_id", "turn", count("frame"), count("transcript"), count("slide"), F.exists("m", lambda m: m["kind"].isin("frame", "slide")).alias("frame_or_slide"))


ASKED = (
    ("What is seen?", "general", "balanced"), ("Are there any boats without sails?", "general", "balanced"), ("Which text does the OCR of the slide hold?", "text_ocr", "balanced"), ("Which brand is it?", "general", "negative_check"),
    ("Pick one." + OPTIONS, "general", "balanced"), ("Which is shown in the video but not mentioned in the audio?" + OPTIONS, "general", "balanced"),
)
SAID = ("", " Answer: A) the red car, likely", " Answer: B) there is no evidence.\nThe blue boat is not supported", " I did not see a person\n\n walking here", " So B) a blue boat\nand nothing else was visible. A) never")


def grounded_rows(spark, sf):
    """Answers of every turn to six questions, with evidence of which some backs their markers."""
    c, n, m = F.col("conv_id"), len(ASKED), len(SAID)
    part = lambda k: F.element_at(F.array(*[F.lit(q[k]) for q in ASKED]), ((c + F.col("turn")) % n + 1).cast("int"))
    span = lambda a, b: F.array(F.struct(F.lit(a).alias("t_start"), F.lit(b).alias("t_end")))
    said = F.element_at(F.array(*map(F.lit, SAID)), ((c * 7 + F.col("turn") * 3) % m + 1).cast("int"))
    a = answers(spark, sf).withColumn("answer", F.concat(F.when((c + F.col("turn")) % 5 == 0, F.col("text")).otherwise(F.col("answer")), said))
    a = a.withColumns({"question": part(0), "question_type": part(1), "profile": part(2), "frames": F.array(F.lit(10.0), F.lit(20.4)), "transcripts": span(4.0, 10.0), "slides": span(2.0, 5.0)})
    row = lambda label, d: F.struct(F.lit(label).alias("label"), F.lit(d).alias("decision"))
    return a.withColumns({"recommended_label": F.when(c % 3 == 0, "B"), "matrix": F.array(row("A", "reject"), row("B", "match"))})


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _grounding_sql() -> str:
    lit = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    pick = lambda k: "[" + ", ".join(lit(q[k]) for q in ASKED) + f"][((conv_id + turn) % {len(ASKED)} + 1)::INT]"
    said = "[" + ", ".join(map(lit, SAID)) + f"][((conv_id * 7 + turn * 3) % {len(SAID)} + 1)::INT]"
    p, vis = predicates, r"\[(FRAME|SLIDE):t=[0-9]"
    tokens = "CASE sel WHEN 'A' THEN ['red', 'car'] ELSE ['blue', 'boat'] END"
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"
    return f"""WITH q AS (SELECT conv_id, turn, {pick(0)} AS q, {pick(1)} AS kind, {pick(2)} AS profile, CASE WHEN (conv_id + turn) % 5 = 0 THEN text ELSE {ANSWER} END || {said} AS a, CASE WHEN conv_id % 3 = 0 THEN 'B' END AS rec FROM conversations),
m AS (SELECT *, lower(q) AS lq, lower(a) AS la, list_transform(regexp_extract_all(a, '\\[FRAME:t=([0-9]+(?:\\.[0-9]+)?)\\]', 1), lambda x: x::DOUBLE) AS fr, list_transform(regexp_extract_all(a, '\\[SLIDE:t=([0-9]+(?:\\.[0-9]+)?)\\]', 1), lambda x: x::DOUBLE) AS sl,
 list_transform(regexp_extract_all(a, '\\[TRANSCRIPT:t=([0-9.]+-[0-9.]+)\\]', 1), lambda x: list_sort([split_part(x, '-', 1)::DOUBLE, split_part(x, '-', 2)::DOUBLE])) AS tr,
 list_filter(list_transform(regexp_split_to_array(a, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines, list_filter(list_transform(regexp_split_to_array(a, '[\\n。！？.!?]+'), lambda x: trim(x)), lambda x: x <> '' AND {_any('lower(x)', p.VISUAL_CLAIMS)}) AS claims,
 contains(q, 'Candidates:') AS mcq, upper(regexp_extract(a, '(?i)\\b(?:answer|correct answer|选项|答案)\\s*[:：]?\\s*\\**([A-E])\\**\\s*[).]', 1)) AS explicit, regexp_extract(a, '\\b([A-E])\\s*[).]\\s+', 1) AS bare FROM q),
s AS (SELECT *, list_filter(claims, lambda c: NOT (regexp_matches(c, '{vis}') OR len(list_filter(lines, lambda x, i: contains(x, c) AND regexp_matches(concat_ws(chr(10), CASE WHEN i > 1 THEN lines[i - 1] END, x, lines[i + 1]), '{vis}'))) > 0)) AS uncited,
 CASE WHEN mcq THEN CASE WHEN explicit <> '' THEN CASE WHEN explicit IN ('A', 'B') THEN explicit END WHEN bare <> '' THEN CASE WHEN bare IN ('A', 'B') THEN bare END WHEN contains({norm('a')}, 'red car') THEN 'A' WHEN contains({norm('a')}, 'blue boat') THEN 'B' END END AS sel,
 len(fr) > 0 OR len(sl) > 0 AS visual, len(sl) > 0 AS slide, (profile = 'negative_check' OR regexp_matches(trim(lq), '^(is|are|was|were) there ') OR regexp_matches(lq, '\\bany\\b') OR {_any('lq', p.NEGATIVE_QUESTION)}) AND {_any('la', p.NEGATIVE)} AS neg,
 kind = 'text_ocr' OR {_any('lq', p.SLIDE_WORDS)} AS asks FROM m),
t AS (SELECT *, asks AND NOT slide AND contains(lq, 'ocr') AS ocr, mcq AND sel IS NULL AS none_, mcq AND sel IS NOT NULL AND coalesce(sel <> rec, false) AS differs, {tokens} AS tk,
 len(list_distinct(list_filter(list_transform(regexp_extract_all(a, '(?i)\\b([A-E])\\s*[).]', 1), lambda x: upper(x)), lambda x: x IN ('A', 'B')))) > 1 AS several FROM s),
u AS (SELECT *, several OR len(list_filter(regexp_split_to_array(a, '[\\n。！？.!?]+'), lambda x: {_any('lower(x)', mcq.REFUTES)} AND (regexp_matches(x, '(?i)\\b' || sel || '\\b') OR len(list_filter(tk, lambda w: contains({norm('x')}, w))) >= 2))) > 0 AS clash_, len(list_filter(tk, lambda w: contains(la, w))) >= 2 AS supports FROM t),
w AS (SELECT *, mcq AND NOT none_ AND NOT differs AND clash_ AS clash, {_any('lq', p.BRAND_SCREEN)} AND {_any('la', p.GUESSES)} AS brand,
 {_any('lq', p.AUDIOVISUAL)} AND {_any('lq', p.HEARD)} AND {_any('lq', p.SEEN)} AND coalesce(sel = 'A', false) AS rejected FROM u),
f AS (SELECT *, list_filter([CASE WHEN len(list_filter(fr, lambda x: least(abs(x - 10.0), abs(x - 20.4)) > 0.65)) > 0 THEN 'invalid_frame_markers' END, CASE WHEN len(list_filter(tr, lambda x: abs(x[1] - 4) > 0.75 OR abs(x[2] - 10) > 0.75)) > 0 THEN 'invalid_transcript_markers' END,
 CASE WHEN len(list_filter(sl, lambda x: x < 1.25 OR x > 5.75)) > 0 THEN 'invalid_slide_markers' END, CASE WHEN len(uncited) > 0 THEN 'uncited_visual_claims' END, CASE WHEN neg AND profile <> 'negative_check' THEN 'negative_without_check' END,
 CASE WHEN neg AND NOT {_any('la', p.NEGATIVE_SCOPE)} THEN 'negative_without_scope' END, CASE WHEN len(claims) > 0 AND NOT visual THEN 'visual_claims_without_marker' END, CASE WHEN ocr THEN 'slide_marker_missing' END, CASE WHEN asks AND NOT ocr AND NOT visual THEN 'visual_marker_missing' END,
 CASE WHEN none_ THEN 'no_candidate_selected' END, CASE WHEN differs THEN 'contradicts_recommended_option' END, CASE WHEN clash THEN 'contradicts_selected_option' END, CASE WHEN mcq AND NOT none_ AND NOT differs AND NOT clash AND NOT supports THEN 'weak_support_of_selected_option' END,
 CASE WHEN rejected THEN 'rejected_by_matrix' END, CASE WHEN brand AND NOT visual THEN 'brand_guess_without_marker' END, CASE WHEN brand AND visual AND NOT slide AND contains(lq, 'brand') THEN 'brand_guess_without_slide' END], lambda x: x IS NOT NULL) AS w FROM w)
SELECT conv_id, turn, array_to_string(w, ',') AS warnings, len(w) = 0 AS grounded, CASE WHEN len(w) = 0 THEN 'final_answer' WHEN brand AND (NOT visual OR (NOT slide AND contains(lq, 'brand'))) THEN 'revise_answer_with_citations'
 WHEN rejected OR clash OR differs THEN 'answer_with_evidence' WHEN neg AND profile <> 'negative_check' THEN 'retrieve_video_evidence' ELSE 'revise_answer_with_citations' END AS next_action, sel AS selected_label, array_to_string(list_slice(uncited, 1, 5), '|') AS uncited FROM f"""


@query("grounding_report", _grounding_sql())
def grounding_report(spark, sf):
    g = grounding.grounding_report(grounded_rows(spark, sf))
    return g.select("conv_id", "turn", F.array_join("warnings", ",").alias("warnings"), "grounded", "next_action", "selected_label", F.array_join("uncited", "|").alias("uncited"))


@query("case_gates", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN toxic = 0 ELSE quality = 1 AND toxic = 0 AND coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END, true) END AS passed FROM labels")
def case_gates(spark, sf):
    i, free = F.col("doc_id"), F.col("toxic") == 0
    gate = evaluation.case_gate(F.when(i % 3 != 0, i % 2 == 0), (F.col("quality") == 1) & free, F.lit(None).cast("boolean"), F.when(i % 5 == 0, True), free, F.lit(True))
    return read(spark, sf, "labels").select("doc_id", gate.alias("passed"))


@query("retrieval_plan_defaults", """WITH p AS (SELECT event_id, ['focused', 'balanced', 'broad', 'temporal', 'detail', 'negative_check', 'other'][event_id % 7 + 1] AS profile, floor(value)::INT % 9 + 1 AS n, floor(value)::INT % 30 + 1 AS k FROM events)
SELECT event_id, least(12, CASE profile WHEN 'focused' THEN least(n, 3) WHEN 'broad' THEN n * 2 WHEN 'temporal' THEN n * 2 WHEN 'negative_check' THEN n * 3 ELSE n END)::INT AS scenes,
 least(36, CASE profile WHEN 'focused' THEN least(k, 8) WHEN 'broad' THEN k * 2 WHEN 'detail' THEN k * 2 WHEN 'negative_check' THEN k * 2 WHEN 'temporal' THEN greatest(k, floor(k * 1.5)) ELSE k END)::INT AS frames FROM p""")
def plan_defaults(spark, sf):
    """A plan for every event: its profile by its id, what is asked for by its value."""
    v = F.floor("value").cast("int")
    profile = F.element_at(F.array(*map(F.lit, (*planner.PROFILES, "other"))), (F.col("event_id") % 7 + 1).cast("int"))
    rows = read(spark, sf, "events").select("event_id", profile.alias("profile"), (v % 9 + 1).alias("n"), (v % 30 + 1).alias("k"))
    n, k = planner.retrieval_plan(F.col("profile"), F.col("n"), F.col("k"))
    return rows.select("event_id", n.cast("int").alias("scenes"), k.cast("int").alias("frames"))


_FACTS = {  # each fact as SQL that Spark and DuckDB read alike, over counts of a user's events
    "frames": "views", "scenes": "clicks", "texts": "searches", "slides": "purchases", "temporal": "user_id % 3 = 0", "candidates": "user_id % 2 = 0", "timeline_rows": "purchases", "found_rows": "least(purchases, searches)",
    "options": "user_id % 4 = 0", "resolved": "user_id % 8 = 0", "span": "clicks * 0.5", "needs_slide": "user_id % 5 = 0", "av": "user_id % 7 = 0", "av_rows": "searches", "av_match": "clicks > 1", "negative": "user_id % 11 = 0",
    "profile": "CASE WHEN user_id % 22 = 0 THEN 'negative_check' ELSE 'balanced' END", "total_scenes": "purchases",
}
_COUNTS = ", ".join(f"count(CASE WHEN event_type = '{k}' THEN 1 END) AS {n}" for k, n in (("view", "views"), ("click", "clicks"), ("search", "searches"), ("purchase", "purchases")))


@query("sufficiency_report", f"""WITH n AS (SELECT user_id, {_COUNTS} FROM events GROUP BY user_id), s AS (SELECT user_id, {", ".join(f"{v} AS {k}" for k, v in _FACTS.items())} FROM n),
r AS (SELECT *, [frames = 0 AND texts = 0, scenes = 0 AND texts = 0, temporal AND candidates AND timeline_rows = 0, temporal AND candidates AND timeline_rows > 0 AND found_rows < timeline_rows,
 temporal AND candidates AND timeline_rows > 0 AND found_rows = timeline_rows AND options AND NOT resolved, temporal AND frames < 8, temporal AND span < 1.0, needs_slide AND slides = 0, av AND av_rows = 0, av AND av_rows > 0 AND NOT av_match,
 negative AND profile <> 'negative_check', negative AND scenes < least(CASE WHEN total_scenes > 0 THEN total_scenes ELSE 12 END, 10), negative AND frames < 24] AS f,
 ['retrieve_video_evidence', 'retrieve_video_evidence', 'build_timeline', 'search_transcript_keyword', 'build_timeline', 'build_timeline', 'expand_temporal_evidence', 'retrieve_slide_evidence', 'align_audiovisual_evidence', 'retrieve_slide_evidence', 'retrieve_video_evidence', 'retrieve_video_evidence', 'retrieve_video_evidence'] AS a,
 ['evidence', 'scenes', 'timeline', 'candidate_hits', 'resolved_option', 'temporal_frames', 'temporal_span', 'slides', 'av_matrix', 'av_match', 'negative_profile', 'negative_scenes', 'negative_frames'] AS names FROM s)
SELECT user_id, NOT list_bool_or(f) AS sufficient, array_to_string(list_filter(names, lambda x, i: f[i]), ',') AS missing, coalesce(list_filter(a, lambda x, i: f[i])[-1], 'answer_with_evidence') AS next_action, CASE WHEN list_bool_or(f) THEN 0.35 ELSE 0.78 END::DOUBLE AS confidence FROM r""")
def sufficiency(spark, sf):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    n = read(spark, sf, "events").groupBy("user_id").agg(kind("view").alias("views"), kind("click").alias("clicks"), kind("search").alias("searches"), kind("purchase").alias("purchases"))
    s = n.selectExpr("user_id", *[f"{v} AS {k}" for k, v in _FACTS.items()])
    ok, gone, action, confidence = planner.sufficiency()
    return s.select("user_id", ok.alias("sufficient"), F.array_join(gone, ",").alias("missing"), action.alias("next_action"), confidence.alias("confidence"))


def _question_sql() -> str:
    p, q = predicates, "lower(text)"
    return f"""SELECT conv_id, turn, regexp_matches(lower(trim(text)), '^(is|are|was|were) there ') OR regexp_matches({q}, '\\bany\\b') OR {_any(q, p.NEGATIVE_QUESTION)} AS negative_question, {_any(q, p.RANKING)} AS ranking, {_any(q, p.SLIDE_WORDS)} AS slide,
 {_any(q, p.BRAND_SCREEN)} AS brand, {_any(q, p.AUDIOVISUAL)} AND {_any(q, p.HEARD)} AND {_any(q, p.SEEN)} AS audiovisual, {_any(q, p.GUESSES)} AS guesses, {_any(q, p.NEGATIVE)} AS negative_answer, {_any(q, p.NEGATIVE_SCOPE)} AS scope, {_any(q, p.UNCERTAINTY)} AS doubt,
 {_any("lower(text || ' general')", p.TEMPORAL_CASE)} AS temporal_case FROM conversations"""


@query("question_predicates", _question_sql())
def predicates_of(spark, sf):
    q, p, kind = F.col("text"), predicates, F.lit("general")
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", p.is_negative_question(q, kind).alias("negative_question"), p.is_ranking_question(q).alias("ranking"), p.needs_slide(q, kind).alias("slide"), p.is_brand_question(q).alias("brand"),
        p.is_audiovisual_question(q).alias("audiovisual"), p.guesses(q).alias("guesses"), p.says_no(q).alias("negative_answer"), p.has_scope(q).alias("scope"), p.is_uncertain(q).alias("doubt"), p.is_temporal_case(q, kind).alias("temporal_case"),
    )


@query("stratified_allocation", "WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), t AS (SELECT sum(size) AS total FROM s) SELECT lang, size, CASE WHEN total <= 100 THEN size ELSE greatest(1, round_even(size / total * 100, 0)::BIGINT) END AS share FROM s, t")
def allocation(spark, sf):
    return sampling.initial_shares(read(spark, sf, "documents"), "lang", 100)


@query("per_group_sample", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= 6")
def group_sample(spark, sf):
    return sampling.per_group(read(spark, sf, "documents").select("source", "doc_id"), "source", 6, F.md5(F.col("doc_id").cast("string")), "doc_id")


@query("simple_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 50")
def simple_sample(spark, sf):
    return sampling.hash_sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 50, 7)


@query("having_min_questions", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 20")
def having(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
