"""Grounding, evaluation, evidence state and parsing on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from lumenframe import udf
from lumenframe.config import Settings
from lumenframe.functions import mcq, parsing
from lumenframe.operators import matrix, search
from lumenframe.plans import evaluation, evidence, grounding, tools
from lumenframe.sources import files
from lumenframe.streaming import chat

ORDER = "What is the order?\n(a) A.\n(b) B.\n\nCandidates:\nA) (b)(a).\nB) (a)(b)."


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def report(spark, answer, question="", frames=(), profile="balanced", kind="general", **more):
    row = spark.range(1).select(F.lit(question).alias("question"), F.lit(answer).alias("answer"), F.lit(profile).alias("profile"), F.lit(kind).alias("question_type"), F.array(*map(F.lit, frames)).cast("array<double>").alias("frames"))
    return grounding.grounding_report(row.withColumns({k: F.expr(v) for k, v in more.items()})).first()


def test_blocks_of_candidates_end_at_any_of_four_phrases(spark):
    for end in ("Answer the question and", "Reference key frames please", "请回答", "回答问题"):
        got = one(spark, mcq.options(F.lit(f"Q\n\nCandidates:\nA) red car\nC) blue\nboat\n \n{end} so")))
        assert [tuple(o) for o in got] == [("A", "red car"), ("C", "blue boat")]
    assert one(spark, mcq.options(F.lit("no options A) x"))) == [] == one(spark, mcq.options(F.lit(None).cast("string")))
    # without a blank line before it the phrase is text
    assert one(spark, mcq.options(F.lit("Candidates:\nA) x\nReference key frames")))[0]["text"] == "x Reference key frames"


def test_repeated_tokens_of_an_option_count(spark):
    opts = F.array(F.struct(F.lit("A").alias("label"), F.lit("bora bora").alias("text")))
    assert tuple(one(spark, mcq.option_scores(F.lit("to bora"), opts))[0]) == ("A", 2, True)


def test_temporal_options_and_contradictions(spark):
    opts = mcq.options(F.lit(ORDER))
    order = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, mcq.temporal_option(opts, order("a", "b")))["label"] == "B"
    assert one(spark, mcq.temporal_option(opts, F.array().cast("array<string>"))) is None
    two = mcq.options(F.lit("Q\n\nCandidates:\nA) Cats are present.\nB) Dogs are present."))
    clash = lambda a, label: one(spark, mcq.option_contradiction(F.lit(a), two, F.lit(label)))
    assert clash("Answer: A) Cats. But B) no", "A")["reason"] == "multiple_candidate_labels"
    assert clash("Answer: A) Cats are present. But A is not supported.", "A")["sentence"] == "But A is not supported"
    assert clash("Answer: A) Cats are present. All good.", "A") is None
    assert one(spark, mcq.recommended_option(F.lit("(B)(a)"), opts))["label"] == "A"
    assert one(spark, mcq.recommended_option(F.lit("dogs are present"), two))["label"] == "B"


def test_grounding_of_plain_answers(spark):
    r = report(spark, "The person is holding a red cup.", frames=[1.0, 2.0])
    assert r["uncited"] and {"uncited_visual_claims", "visual_claims_without_marker"} <= set(r["warnings"]) and r["next_action"] == "revise_answer_with_citations"
    r = report(spark, "In the checked frames, I do not see a cat.\n[FRAME:t=1.0]", "Is there a cat in the video?", [1.0], "negative_check")
    assert r["grounded"] and r["next_action"] == "final_answer" and r["valid"] == 1
    r = report(spark, "The speaker wears a green plaid shirt. No tie or jacket is visible. [FRAME:t=1.0]", "What is the speaker wearing?", [1.0])
    assert r["grounded"]
    r = report(spark, "I do not see a cat. [FRAME:t=1.0]", "Is there a cat in the video?", [1.0])
    assert "negative_without_check" in r["warnings"] and r["next_action"] == "retrieve_video_evidence"
    r = report(spark, "It compares A and B. [TRANSCRIPT:t=10.0-14.0]", transcripts="array(struct(10D as t_start, 14D as t_end))")
    assert r["grounded"] and r["valid"] == 1
    assert report(spark, None, None)["grounded"]


def test_grounding_of_choices(spark):
    two = "Which is true?\n\nCandidates:\nA) Cats are present.\nB) Dogs are present."
    assert report(spark, "The evidence is mixed. [FRAME:t=1.0]", two, [1.0])["warnings"] == ["no_candidate_selected"]
    r = report(spark, "Answer: A) Cats are present. But A is not supported by the evidence. [FRAME:t=1.0]", two, [1.0])
    assert "contradicts_selected_option" in r["warnings"] and r["next_action"] == "answer_with_evidence"
    r = report(spark, "Answer: A) (b)(a). [FRAME:t=1.0]", ORDER, [1.0], recommended_label="'B'")
    assert "contradicts_recommended_option" in r["warnings"] and r["next_action"] == "answer_with_evidence"
    av = "Which company is featured in the video but not mentioned in the audio?\n\nCandidates:\nA) Dairy Queen.\nB) American Express."
    r = report(spark, "Answer: A) Dairy Queen. [FRAME:t=1.0]", av, [1.0], matrix="array(struct('A' as label, 'reject' as decision))")
    assert "rejected_by_matrix" in r["warnings"]
    brand = "What is the recommended brand of the shoe cleaner?\n\nCandidates:\nA) SNEAKER LAB.\nB) JASON MARKK."
    r = report(spark, "Answer: B) JASON MARKK. This is typical of the standard product. [FRAME:t=1.0]", brand, [1.0])
    assert "brand_guess_without_slide" in r["warnings"]
    assert "brand_guess_without_marker" in report(spark, "Probably B) JASON MARKK.", brand)["warnings"]


def case(spark, judge=None, **more):
    prediction = {k: more.pop(k) for k in ("answer", "agent_actions", "retrieved_timestamps", "scene_hits", "evidence_sufficiency") if k in more}
    cases = evaluation.parse_cases(spark.createDataFrame([(json.dumps({"case_id": "c-1", "question": "Q"} | more),)], "value string"))
    found = evaluation.parse_predictions(spark.createDataFrame([(json.dumps({"case_id": "c-1"}), 0), (json.dumps({"case_id": "c-1"} | prediction), 1)], "value string, pos int"))
    rows = evaluation.join_predictions(cases, found)[0].withColumn("judge", F.lit(judge).cast("boolean"))
    return evaluation.evaluate_cases(rows, "judge").first()


def test_cases_are_parsed_with_aliases_and_defaults(spark):
    raw = {"question_id": "q-1", "question": "Q", "expected_keywords": ["A2C"], "expected_citation_kinds": "Audio, ppt, visual_evidence, audio, x", "modality_tag": " Joint "}
    c = evaluation.parse_cases(spark.createDataFrame([(json.dumps(raw),)], "value string")).first()
    assert (c["case_id"], c["required_keywords"], c["expected_citation_kinds"], c["expected_citation_min"], c["modality_tag"]) == ("q-1", ["A2C"], ["transcript", "slide", "frame_or_slide"], 1, "joint")
    with pytest.raises(Exception, match="case_id"):
        evaluation.parse_cases(spark.createDataFrame([('{"question": "Q"}',)], "value string")).collect()


def test_case_sections(spark):
    r = case(spark, answer="The person holds a cat.\n[FRAME:t=9.0]", retrieved_timestamps=[1.0], required_keywords=["person"], forbidden_keywords=["cat"])
    s = r["answer_section"]
    assert not r["passed"] and not s["hallucination_free"] and not s["citation_correct"] and s["answered"] and r["retrieval"]["passed"] is None
    r = case(spark, answer="REINFORCE and A2C. [TRANSCRIPT:t=10-14] TD target. [SLIDE:t=72.0]", expected_keywords=["REINFORCE", "A2C", "TD target"], expected_citation_min=2, expected_citation_kinds=["transcript", "slide"])
    assert r["passed"] and r["answer_section"]["coverage"] == {"transcript": True, "slide": True} and r["failure_tags"] == []
    r = case(spark, answer="x [FRAME:t=1.0]", gold_timestamps=[1.0, 50.0], gold_scenes=[{"start": 0, "end": 2}], retrieved_timestamps=[2.5], scene_hits=[{"start": 2, "end": 3}], needs_expansion=True)
    assert (r["retrieval"]["recall"], r["retrieval"]["distance"], r["retrieval"]["scene_accuracy"], r["retrieval"]["passed"]) == (0.5, 24.5, 1.0, False)
    assert r["failure_tags"] == ["agent_loop_issue", "missing_citation_kind", "retrieval_issue"]
    r = case(spark, True, answer="no keyword", required_keywords=["dog"], gold_timestamps=[1.0], retrieved_timestamps=[40.0], expected_action="build_timeline")
    assert r["passed"] and r["failure_tags"] == []  # the judge waives all but hallucination and doubt
    assert not case(spark, True, answer="a cat", forbidden_keywords=["cat"])["passed"]
    assert case(spark, answer="The checked frames don't show it.", requires_uncertainty=True)["passed"]
    assert not case(spark, answer="I cannot see red", requires_uncertainty=True)["answer_section"]["uncertainty_ok"]
    assert case(spark, answer="无法确定", requires_uncertainty=True)["passed"]


def test_failure_tags(spark):
    q = "What is the correct order?\n(a) Cats.\n(b) Dogs.\n\nCandidates:\nA) (a)(b).\nB) (b)(a)."
    r = case(
        spark, False, question=q, reference_answer="(a)(b).", expected_keywords=["(a)(b)"], expected_citation_kinds=["frame_or_slide"], question_type="temporal reasoning",
        answer="Answer: B) (b)(a). [TRANSCRIPT:t=1.0-2.0]", agent_actions=["retrieve_transcript_evidence", "answer_with_evidence", "retrieve_video_evidence"],
    )
    assert {"wrong_temporal_option", "temporal_order_error", "missing_frame_or_slide", "post_answer_retrieval"} <= set(r["failure_tags"])
    assert (r["selected_option"]["label"], r["recommended_option"]["label"]) == ("B", "A")
    brand = "What is the recommended brand?\n\nCandidates:\nA) SNEAKER LAB.\nB) JASON MARKK."
    r = case(spark, False, question=brand, expected_citation_kinds=["slide"], answer="Answer: B) JASON MARKK. This is typical of the standard product. [FRAME:t=1.0]")
    assert {"unsupported_visual_brand_guess", "missing_slide"} <= set(r["failure_tags"]) and "wrong_fact_option" not in r["failure_tags"]


def test_report_and_exit_code(spark):
    raw = [json.dumps({"case_id": f"{g}-{i}", "question": "Q", "required_keywords": ["ok"]}) for g, i in (("lvb", 1), ("lvb", 2), ("", 3))]
    said = [json.dumps({"case_id": f"{g}-{i}", "answer": a}) for g, i, a in (("lvb", 1, "ok"), ("lvb", 2, ""))]
    cases = evaluation.parse_cases(spark.createDataFrame([(x,) for x in raw], "value string"))
    both, missing = evaluation.join_predictions(cases, evaluation.parse_predictions(spark.createDataFrame([(x, i) for i, x in enumerate(said)], "value string, pos int")))
    results = evaluation.evaluate_cases(both)
    text = evaluation.report(results, missing)
    assert "| all | 2 | 1 | 0.500 |" in text and "- no_final_answer: 1" in text and "- -3" in text
    assert [evaluation.exit_code(0.5, 0.6, 0), evaluation.exit_code(0.6, 0.6, 0), evaluation.exit_code(1.0, 0.6, 1)] == [1, 0, 2]
    assert [r["group"] for r in evaluation.summary(results).orderBy("group").collect()] == [None, "lvb"]


def session(spark, **cols):
    return tools.state(spark.range(1).withColumns({k: v if not isinstance(v, str) else F.expr(v) for k, v in cols.items()}))


def test_tools_take_a_session_to_an_answer(spark):
    text = "named_struct('kind', '{}', 't_start', {}D, 't_end', {}D, 'text', '{}', 'score', 1D)"
    s = session(
        spark, question=F.lit("What is the order?\n(a) open the red door.\n(b) close window slowly.\n\nCandidates:\nA) (b)(a).\nB) (a)(b)."), question_type="'temporal_order'", profile="'temporal'",
        dense="transform(sequence(0, 99), x -> cast(x as double))", duration="100D", hits="array(30D, 10D, 10.04D)", found="array(named_struct('start', 9D, 'end', 12D, 'caption', 'a room'))",
        heard=f"array({text.format('transcript', 30, 32, 'they close the window slowly')}, {text.format('transcript', 5, 8, 'open a red door')})",
        windows="array(named_struct('start', 40D, 'end', 30D), named_struct('start', -5D, 'end', 2D), named_struct('start', cast(null as double), 'end', 2D))",
    )
    assert tools.assess(s).first()["recommended_next_action"] == "expand_temporal_evidence"
    r = tools.plan(s).first()
    assert (r["n_scenes"], r["n_frames"]) == (10, 18)
    s = tools.retrieve_texts(tools.retrieve_video(s, "hits", "found"), "transcripts", "heard")
    assert [f["timestamp"] for f in s.first()["frames"]] == [10.0, 30.0]
    s = tools.build_timeline(s)
    r = s.first()
    assert r["inferred_order"] == ["a", "b"] and r["recommended_option"]["label"] == "B" and [c["t"] for c in r["candidates"]] == [5.0, 30.0]
    assert [e["type"] for e in r["timeline"]][:2] == ["frame", "frame"] and len(r["frames"]) == 14
    assert tools.assess(s).first()["sufficient"]
    s = tools.stitched_verify(s, "windows", "question")
    r = s.first()
    assert [(w["start"], w["end"], w["frame_count"]) for w in r["window_frames"]] == [(0.0, 2.0, 3), (30.0, 40.0, 11)] and len(r["notes"]) == 1 and r["window_warning"] is None
    s = tools.segment_focus(s.withColumns({"c": F.lit(99.0), "h": F.lit(3.0)}), "c", "h", "question")
    assert tuple(s.first()["focus"]) == (96.0, 100.0, 98.0) and len(s.first()["notes"]) == 2
    s = tools.answer(s.withColumn("said", F.lit(" Answer: A) (b)(a). [TRANSCRIPT:t=5.0-8.0] ")), "said")
    r = s.first()
    assert "contradicts_recommended_option" in r["warnings"] and r["error"] is None and r["answer"].startswith("Answer")
    r = tools.answer(s.drop("warnings", "grounded", "next_action", "selected_label", "uncited", "invalid", "valid", "error").withColumn("said", F.lit("cut �")), "said").first()
    assert r["error"] == "empty_or_truncated_answer" and r["answer"].startswith("Answer")
    assert "Resolved option: B" in s.select(tools.answer_prompt(s).alias("p")).first()["p"]


def test_state_caps_and_ties(spark):
    frames = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(i.cast("double").alias("timestamp"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("hypothesis")))
    got = one(spark, evidence.merge_frames(evidence.empty(evidence.FRAME), frames))
    assert len(got) == 36 and got[0]["timestamp"] == 0 and got[-1]["timestamp"] == 99
    text = lambda k, a, t, s: F.struct(F.lit(k).alias("kind"), F.lit(a).alias("t_start"), F.lit(None).cast("double").alias("t_end"), F.lit(t).alias("text"), F.lit(s).alias("score"))
    got = one(spark, evidence.merge_texts(F.array(text("slide", 1.001, "x", 1.0), text("", 1.0, "x", 9.0)), F.array(text("slide", 1.0, "x", 2.0), text("slide", 0.5, " ", 1.0), text("asr", 7.0, "y", None))))
    assert [(t["kind"], t["t_start"], t["score"]) for t in got] == [("asr", 7.0, 0.0), ("slide", 1.0, 2.0)]
    assert one(spark, evidence.span(F.array(F.lit(3.0)))) == 0 and one(spark, evidence.span(F.array(F.lit(3.0), F.lit(1.0)))) == 2


def test_audiovisual_matrix(spark):
    q = "Which company is featured in the video but not mentioned in the audio?\n\nCandidates:\nA) Dairy Queen.\nB) American Express."
    item = lambda kind, t, x: f"array(named_struct('kind', '{kind}', 't_start', {t}D, 't_end', {t}D, 'text', '{x}', 'score', 1D))"
    s = session(spark, question=F.lit(q), transcripts=item("transcript", 1, "Dairy Queen is mentioned."), slides=item("slide", 5, "American Express logo"))
    m = {r["label"]: r for r in tools.with_matrix(s).first()["matrix"]}
    assert (m["A"]["audio"], m["A"]["decision"], m["B"]["visual"], m["B"]["audio"], m["B"]["decision"], m["B"]["marker"]) == (True, "reject", True, False, "match", "[SLIDE:t=5.0]")
    assert one(spark, evidence.audiovisual_matrix(F.lit("What is it?"), mcq.options(F.lit(q)), evidence.evidence_items(evidence.empty(evidence.TEXT), evidence.empty(evidence.TEXT), evidence.empty(evidence.SCENE)), F.array().cast("array<struct<text: string>>"))) == []


def test_seen_spread_over_texts(spark):
    options = spark.createDataFrame([("A", "alpha beta gamma"), ("B", "delta beta"), ("C", "none here"), ("D", "")], "label string, text string")
    evidence_ = spark.createDataFrame([(5, "ALPHA x"), (1, "the betamax"), (2, "gamma"), (7, "delta and beta"), (8, None)], "ord long, text string")
    got = {r["label"]: (r["seen"], r["ord"]) for r in matrix.seen_in(options, evidence_).collect()}
    assert got == {"A": (True, None), "B": (True, 7), "C": (False, None), "D": (False, None)}


def test_matrix_in_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(str(i), f"word{i} door") for i in range(30)], "label string, text string")
    e = spark.createDataFrame([(i, float(i % 3), f"a door and Word{i % 31}s") for i in range(90)], "ord long, t double, text string").repartition(5)
    want = sorted(map(tuple, matrix.candidate_timeline(c, e).collect()))
    monkeypatch.setattr(matrix, "BLOCK", 7)
    monkeypatch.setattr(matrix, "CACHE", 50)
    assert sorted(map(tuple, matrix.candidate_timeline(c, e).collect())) == want
    hits = lambda i, t: sum(x in t.lower() for x in (f"word{i}", "door"))
    for label, status, t, ord_, n in want:
        best = max(((hits(int(label), f"a door and Word{i % 31}s"), -(i % 3), -i) for i in range(90)))
        assert (n, t, ord_) == (best[0], -best[1], -best[2]) if best[0] >= 1 else status == "missing"


def test_bm25_folds_and_phrases(spark):
    d = spark.createDataFrame([(1, "Café au lait"), (2, "the TD target is here"), (3, "target TD"), (4, None), (5, "中文分词")], "doc_id long, text string")
    ids = lambda q: sorted(r["doc_id"] for r in search.bm25(d, q).collect())
    assert ids("cafe") == [1] and ids("td-target") == [2] and ids('"TD" lait') == [1, 2, 3] and ids("中文") == [] and ids("中文分词") == [5] and ids(' "" ') == []


def test_parsing(spark):
    xs = lambda t: one(spark, parsing.float_list(F.lit(t)))
    assert xs("[1, 2.5]") == [1, 2.5] and xs(' "3", 4 ') == [3, 4] and xs(" ") is None and xs("1, x") is None
    d = one(spark, parsing.subject_deltas(F.lit('Yes.\nSUBJECT_DELTAS: {"deltas": [{"op": "add", "id": "p"}]}\nbye')))
    assert d["text"] == "Yes.\nbye" and d["deltas"][0]["id"] == "p"
    d = one(spark, parsing.subject_deltas(F.lit('Yes.\nSUBJECT_DELTAS: {"deltas":\n[{"op": "add", "id": "p"}]}')))
    assert d["text"] == "Yes." and d["deltas"][0]["op"] == "add"
    d = one(spark, parsing.subject_deltas(F.lit('Yes.\nSUBJECT_DELTAS: {"del')))
    assert d["text"] == "Yes." and d["deltas"] == []
    assert one(spark, parsing.subject_deltas(F.lit(" plain ")))["text"] == "plain"
    assert one(spark, parsing.message_text(F.lit('[{"text": "a"}, "b", {"image": 1}]'))) == "ab" and one(spark, parsing.message_text(F.lit("[not json"))) == "[not json"
    parts = one(spark, parsing.citation_parts(F.lit("x [FRAME:t=1.0] y [TRANSCRIPT:t=1-2]")))
    assert [(p["text"], p["marker"]) for p in parts] == [("x ", "[FRAME:t=1.0]"), (" y ", "[TRANSCRIPT:t=1-2]"), ("", None)]
    assert one(spark, parsing.option_keywords(F.lit("B. (a) (b)"))) == ["(a)(b)"] and one(spark, parsing.option_keywords(F.lit("A) The Red red Car of one."))) == ["Red", "Car"]
    assert one(spark, parsing.ocr_text(parsing.ocr_blocks(F.lit('[["b", " Hi ", "0.9"], ["b"], ["b", "you", "x"], ["b", "two", "1"]]')))) == "Hi\ntwo"
    j = lambda t: one(spark, evaluation.judge_json(F.lit(t)))
    assert tuple(j('```json\n{"correct": true, "score": 4}\n```'))[:2] == (True, 4.0) and j("none")["error"] == "json" and j('{"correct": true, "score": "5"}')["score"] is None
    assert one(spark, parsing.frame_name(F.lit(7.25)), parsing.time_index(F.lit(100.0), F.lit(1.0), F.lit(50))) in (("t0007.2.jpg", 49), ("t0007.3.jpg", 49))


def test_chat_fold():
    f = chat.Fold()
    sent = [x for kind, data in (("token", {"text": "pl"}), ("token", {"text": "an"}), ("plan_end", {"tool_calls": [1]}), ("tool", {"updates": [{"frames": [1.0]}, {}]}), ("token", {"text": "so"}), ("end", {})) for x in f.feed(kind, data)]
    assert sent == [("frames", {"frames": [1.0], "scene_hits": [], "transcripts": [], "slides": []}), ("token", {"text": "so"}), ("done", {})] and f.answer == "so"
    f = chat.Fold()
    assert [x for kind, data in (("token", {"text": "hi"}), ("plan_end", {})) for x in f.feed(kind, data)] == [("token", {"text": "hi"})]
    f = chat.Fold()
    assert f.feed("end", {"last_answer": "late"}) == [("token", {"text": "late"}), ("done", {})] and f.feed("error", {"detail": "x"}) == [("error", {"detail": "x"})]


def test_sse_stream(spark, tmp_path):
    spark.createDataFrame([("token", '{"text": "a"}')], "event string, data string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event string, data string").parquet(str(tmp_path / "in"))
    chat.write_sse(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert "event: token\ndata: {\"text\": \"a\"}" in "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*"))


def test_model_backends(spark):
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("503")
        return "ok"

    assert udf.Retry(flaky, sleep=waits.append)("x") == "ok" and waits == [1.0, 2.0]
    asked = []

    def long(frames, side):
        asked.append((len(frames), side))
        if len(frames) > 2:
            raise ValueError("prompt too long")
        return "ok"

    assert udf.degrade(list(range(8)), 400, long) == "ok" and asked == [(8, 400), (4, 300), (2, 225)]
    import numpy as np

    ramp = np.tile(np.arange(9), (8, 1))
    assert udf.difference_hash(ramp) == -1 and udf.difference_hash(ramp[:, ::-1]) == 0
    rows = spark.createDataFrame([("a.mp4",), ("b.broken",), (None,)], "path string")
    got = {r["path"]: r["error"] for r in udf.probe(rows, "path").collect()}
    assert got["a.mp4"] is None and "moov" in got["b.broken"]
    assert all(r["t_end"] - r["t_start"] >= 0.2 for r in udf.transcribe(rows, "path").collect())
    assert udf.slide_texts(rows, "path", lambda p: [["box", "Title", 0.9]] if p.startswith("a") else []).select("path", "text").collect() == [("a.mp4", "Title")]
    cache = spark.createDataFrame([("a.mp4", "known")], "path string, value string")
    got = {r["path"]: r["out"] for r in udf.read_through(rows.where("path is not null"), cache, "path", "path", "out", lambda p: "new").collect()}
    assert got == {"a.mp4": "known", "b.broken": "new"}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1, 9.5, 2.0, " hi & bye "), ("v", 2, 12.0, 13.0, "x")], "video string, ord int, t_start double, t_end double, text string")
    assert files.write_segments(rows, "transcript", str(tmp_path / "t"), "video", "ord", str(tmp_path / "vtt")) == 2
    back = {r["ord"]: (r["t_start"], r["t_end"], r["text"], r["source"]) for r in spark.read.json(str(tmp_path / "t")).collect()}
    assert back[1] == (2.0, 9.5, "hi & bye", "asr")
    files.append_csv(spark.createDataFrame([("r1", 0.5)], "run string, rate double"), str(tmp_path / "runs"))
    files.append_csv(spark.createDataFrame([("r2", 0.6)], "run string, rate double"), str(tmp_path / "runs"))
    assert sorted(map(tuple, files.read_csv_index(spark, str(tmp_path / "runs"), "run string, rate double").collect())) == [("r1", 0.5), ("r2", 0.6)]
    (tmp_path / "g.json").write_text('{"v1": {"location": {"q1": [[1, 2], [3, 4]]}}}')
    assert [tuple(r) for r in files.read_nested(spark, str(tmp_path / "g.json")).collect()] == [("v1", "q1", [[1.0, 2.0], [3.0, 4.0]])]
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json(spark, str(tmp_path / "l.json")).count() == 2
    for name in ("t0001.5.jpg", "t0010.0.jpg", "x.jpg"):
        (tmp_path / "frames").mkdir(exist_ok=True)
        (tmp_path / "frames" / name).write_bytes(b"jpg")
    assert [r["ts"] for r in files.read_frames(spark, str(tmp_path / "frames")).collect()] == [1.5, 10.0]
    files.dense_frame_index(spark.createDataFrame([("v1", 2.0)], "video_id string, duration double"), str(tmp_path / "index"), udf.hashed_vector)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2
    files.mark_done(spark, str(tmp_path / "index"))
    assert files.purge(spark, str(tmp_path / "index"), str(tmp_path / "nothing")) == 1


def test_settings():
    s = Settings.load({"LUMENFRAME_TOP_N_SCENES": "7", "LUMENFRAME_DENSE_FPS": "fast"})
    assert (s.top_n_scenes, s.dense_fps) == (7, 1.0)
