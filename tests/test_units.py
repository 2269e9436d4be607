"""Small expectations of operators and functions."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe import udf
from lumenframe.functions import markers, mcq, numeric, text
from lumenframe.operators import intervals, matrix, sampling, search
from lumenframe.plans import evaluation, grounding, planner
from lumenframe.sources import files
from lumenframe.streaming import state


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_scene_quota():
    assert [search.scene_quota(*a) for a in ((12, True), (12, False), (1, True), (4, True))] == [8, 12, 1, 2]


def test_even_indices(spark):
    assert one(spark, numeric.even_indices(F.lit(5), 8)) == [0, 1, 2, 3, 4]
    assert one(spark, numeric.even_indices(F.lit(10), 1)) == [5]
    assert one(spark, numeric.even_indices(F.lit(0), 3)) == []
    got = one(spark, numeric.even_indices(F.lit(100), 12))
    assert len(got) == 12 and got[0] == 0 and got[-1] == 99


def test_markers_keep_text_order(spark):
    got = one(spark, markers.extract(F.lit("a [SLIDE:t=72.0] b [TRANSCRIPT:t=9-2.5] c [FRAME:t=1]")))
    assert [(m["kind"], m["t_start"], m["t_end"]) for m in got] == [("slide", 72.0, 72.0), ("transcript", 2.5, 9.0), ("frame", 1.0, 1.0)]


def test_postprocess(spark):
    assert one(spark, text.postprocess(F.lit("😊 td   and a 二 c with rl"))) == "TD and A2C with RL"


def test_mcq(spark):
    q = "Q?\n\nCandidates:\nA) red car\nB) blue  boat\n\nAnswer the question and reference key frames with [FRAME:t=...] markers."
    opts = mcq.options(F.lit(q))
    assert [tuple(o) for o in one(spark, opts)] == [("A", "red car"), ("B", "blue boat")]
    assert one(spark, mcq.selected_label(F.lit("I think the blue boat"), opts)) == "B"
    assert one(spark, mcq.selected_label(F.lit("answer: **a**) sure"), opts)) == "A"
    assert [tuple(e) for e in one(spark, mcq.events(F.lit("(a) first thing\n(b) second\n\nCandidates:\nA) x")))] == [("a", "first thing"), ("b", "second")]
    assert one(spark, mcq.order_sequence(F.lit("(B)(a)(c)"))) == ["b", "a", "c"]


def test_candidate_timeline(spark):
    c = spark.createDataFrame([("a", "open the red door"), ("b", "close window slowly"), ("c", "plays guitar loudly")], "label string, text string")
    e = spark.createDataFrame([(0, 30.0, "they open a red door"), (1, 10.0, "close the window slowly"), (2, 50.0, "he plays guitar loudly")], "ord long, t double, text string")
    t = matrix.candidate_timeline(c, e)
    assert {(r["label"], r["t"]) for r in t.collect()} == {("a", 30.0), ("b", 10.0), ("c", 50.0)}
    assert tuple(matrix.recommended_order(t).first()) == (["b", "a", "c"], True)


def test_nearest_ties_and_missing(spark):
    g = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "k int, gold_t double")
    f = spark.createDataFrame([(1, 9.0), (1, 11.0), (1, 40.0)], "k int, t double")
    got = {(r["k"], r["gold_t"]): (r["nearest_t"], r["distance"]) for r in intervals.nearest(g, f, "k").collect()}
    assert got == {(1, 10.0): (9.0, 1.0), (1, 20.0): (11.0, 9.0), (2, 5.0): (None, None)}


def test_overlap_crosses_buckets_once(spark):
    s = spark.createDataFrame([(1, 3500.0, 7300.0)], "k int, t_start double, t_end double")
    at = spark.createDataFrame([(1, 3600.0)], "k int, t double")
    assert intervals.overlapping(s, "k", at, 4000.0).count() == 1


def test_repair():
    # the densest stratum is at one already, so nothing is taken away
    assert sampling.repair([("a", 90, 9), ("b", 5, 1), ("c", 5, 1)], 10) == {"a": 9, "b": 1, "c": 1}
    assert sampling.repair([("a", 10, 5), ("b", 40, 6)], 10) == {"a": 4, "b": 6}
    assert sampling.repair([("a", 3, 1), ("b", 1, 1)], 9) == {"a": 3, "b": 1}


def test_answer_evaluation(spark):
    df = spark.createDataFrame([("A red bus [FRAME:t=9.9]", ["red"], ["cat"], False, [10.0]), ("A cat [FRAME:t=50]", ["cat"], ["cat"], False, [10.0])], "answer string, required array<string>, forbidden array<string>, requires_uncertainty boolean, frames array<double>")
    got = evaluation.evaluate_answer(df).select("answered", "hallucination_free", "citation_correct", "answer_passed").collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (True, False, False, False)]


def test_uncited_claim_sees_the_next_line(spark):
    assert one(spark, grounding.uncited_claims(F.lit("A person walking\n[FRAME:t=3.0]"))) == []
    assert one(spark, grounding.uncited_claims(F.lit("A person walking\nx\n[FRAME:t=3.0]"))) == ["A person walking"]


def test_sufficiency_last_action_wins(spark):
    base = {"frames": 4, "scenes": 1, "texts": 0, "slides": 0, "temporal": False, "candidates": False, "timeline_rows": 0, "found_rows": 0, "options": False, "resolved": False, "span": 0.0, "needs_slide": True, "av": False, "av_rows": 0, "av_match": False, "negative": True, "profile": "balanced", "total_scenes": 0}
    ok, gone, action, confidence = planner.sufficiency()
    r = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()]).select(ok.alias("a"), gone.alias("b"), action.alias("c"), confidence.alias("d")).first()
    assert tuple(r) == (False, ["slides", "negative_profile", "negative_scenes", "negative_frames"], "retrieve_video_evidence", 0.35)


def test_registry_fold():
    deltas = [
        {"op": " Add", "id": "p1", "first_seen_t": 3.0, "attributes": ["z", "a"], "evidence_frames": [1.04, "x"]},
        {"op": "update", "id": "ghost", "attributes_add": ["x"]},
        {"op": "update", "id": "p1", "attributes_add": ["b"]},
        {"op": "update", "id": "p1", "attributes_add": ["b", " "], "last_seen_t": 9.0},
        {"op": "drop", "id": "p1"},
        {"op": "add", "id": " "},
        "no delta",
    ]
    assert state.fold_registry(deltas) == [{"id": "p1", "label": "p1", "first_seen_t": 3.0, "last_seen_t": 9.0, "attributes": ["a", "b", "z"], "evidence_frames": [1.0]}]
    many = [{"op": "add", "id": f"p{i}", "first_seen_t": float(i)} for i in range(20)]
    assert [e["id"] for e in state.fold_registry(many)][:2] == ["p19", "p18"] and len(state.fold_registry(many)) == 15


def test_jsonl_and_cache(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"key": "k", "value": "1", "seq": 1}\nnot json\n\n{"key": "k", "value": "2", "seq": 2}\n')
    assert files.read_jsonl(spark, str(p), "key string, value string, seq long").where("key is not null").count() == 2
    assert [tuple(r) for r in files.read_cache(spark, str(p)).where("key is not null").collect()] == [("k", "2")]
    q = tmp_path / "b.jsonl"
    q.write_text('# note\n\n{"key": "a"}\n')
    assert files.read_jsonl_strict(spark, str(q), "key string").count() == 1
    q.write_text("{bad\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl_strict(spark, str(q), "key string").collect()


def test_vtt(spark, tmp_path):
    s = spark.createDataFrame([("v", 0, "a < b", 1.0, 3661.5)], "video string, ord int, text string, t_start double, t_end double")
    files.write_vtt(s, "video", "ord", str(tmp_path / "vtt"))
    got = "".join(p.read_text() for p in (tmp_path / "vtt").rglob("part-*"))
    assert got.startswith("WEBVTT") and "1\n00:00:01.000 --> 01:01:01.500\na &lt; b" in got


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 2, "b"), (1, 2, "x")], "k int, ts int, stage string")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = state.run_to_memory(state.latest_progress(stream, "k", "ts", "stage"), "latest", str(tmp_path / "cp"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in state.latest_progress(e, "k", "ts", "stage").collect()}


def test_interval_plan_has_an_equi_key(spark):
    p = spark.createDataFrame([(1, 1.0)], "k int, ts double")
    s = spark.createDataFrame([(1, 0.0, 2.0)], "k int, start double, end double")
    plan = intervals.points_in_intervals(p, s, "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_resolve_files_keeps_one_row_a_name(spark):
    there = ["/v/1/clip1.webm", "/v/2/clip1.mkv", "/a/clip1.mp3", "/a/b/c.tar.gz", "/b/c.MP4", "/a/c.MP4", "/x/d.mp4", "/w/d.mp4", "/x/", "/q/.mp4", "/q/e"]
    asked = ["clip1.mp4", "clip1.mp4", "clip1", "c.MP4", "b/c.MP4", "c", "d.avi", "x/d.mp4", "/w/d.mp4", "c.tar", "none.mp4", "", ".mp4", "e.mov", "e", None]
    ends = (".mp4", ".mkv", ".webm", ".tar.gz", "")

    def best(name):
        own = (name or "").split("/")[-1]
        stem = re.sub(r"\.[A-Za-z0-9]+$", "", own)
        bases = [own, *[stem + e for e in ends]]
        fit = [(-1 if p == name or p.endswith(f"/{name}") else bases.index(b), p) for p in there if (b := p.split("/")[-1]) in bases]
        return min(fit)[1] if fit and name is not None else None

    found = files.resolve_files(spark.createDataFrame([(n,) for n in asked], "name string"), spark.createDataFrame([(p,) for p in there], "path string"), extensions=ends)
    assert sorted(((r["name"], r["path"]) for r in found.collect()), key=repr) == sorted(((n, best(n)) for n in asked), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Generate " in x] and not [x for x in plan.splitlines() if "Generate " in x and "name#" in x]


def test_option_scores_search_the_folded_text(spark):
    opts = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in (("A", "Red-CAR, red 汽车站 the x"), ("B", " .. "), ("C", "river"))])
    texts = [None, "", "a RED.car", "re d ca r", "Das 汽车站!", "the,River\n", "riv er"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    low = text.normalize("t")
    want = F.transform(opts, lambda o: F.size(F.filter(text.content_tokens(o["text"]), lambda k: F.contains(low, k))))
    found = d.select("i", want.alias("want"), mcq.option_scores("t", opts).alias("s"), mcq.token_scores("t", mcq.option_tokens(opts)).alias("k"))
    for r in found.collect():
        assert [x["hits"] for x in r["s"]] == r["want"] and r["s"] == r["k"]
    plan = d.select(mcq.token_scores("t", F.array(F.struct(F.lit("A").alias("label"), F.array(F.col("t")).alias("tokens")))))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # no pattern runs over the texts


def test_candidates_hold_no_batch_and_few_runs():
    batch = pa.record_batch({"ord": list(range(5000)), "text": ["x" * 10, None] * 2498 + ["y" * matrix.PIECE] * 4})
    parts = list(matrix.pieces(batch, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) <= matrix.ROWS
    assert max(sum(len(x or "") for x in p.column(1).to_pylist()) for p in parts) <= matrix.PIECE
    finder = matrix.Finder(["abc"])
    for i in range(400_000):
        finder.in_run(f"r{i}")
    assert len(finder.known) * matrix.RUN_BYTES <= matrix.CACHE and finder.in_run("xabcx").tolist() == [0]


def test_backends_get_pieces_in_order(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "case when id % 7 = 0 then null when id % 7 = 1 then '' else 't' || id end as t").repartition(3)
    replies = udf.map_text(rows, "t", "out", lambda x: f"<{x}>")
    assert all(r["out"] == (None if r["t"] is None else f"<{r['t']}>") for r in replies.collect())
    assert "ArrowEvalPython" in replies._jdf.queryExecution().executedPlan().toString()
    sizes = []
    monkeypatch.setattr(udf.F, "arrow_udf", lambda kind: lambda call: lambda c: sizes.append(call) or c)
    udf._in_pieces(rows, "t", "out", "string", lambda texts: sizes.append(len(texts)) or pa.array(texts, pa.string()))
    whole = pa.array(["z" * 100] * 4000 + [None, "q" * (3 * udf.PIECE)], pa.string())
    out = list(sizes.pop()(iter([whole, pa.array([], pa.string())])))
    assert out[0].equals(whole) and len(out[1]) == 0 and max(sizes) <= udf.ROWS and sum(sizes) == 4002
