"""Text and vector indexes: pruned plans, replaced owners, phrases, recall; tools that search for themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import search, textindex
from lumenframe.operators.textindex import SPREAD, TextIndex, bucket_of, phrases_of
from lumenframe.operators.vectorindex import VectorIndex, fit
from lumenframe.plans import tools

CHUNK = "video string, kind string, doc long, text string, t_start double, t_end double"


def chunks(spark, rows):
    return spark.createDataFrame([(v, k, d, t, d * 3.0, d * 3.0 + 4) for v, k, d, t in rows], CHUNK)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def some(spark):
    rng = random.Random(1)
    words = "red car blue dog the of a green tree river stone über naïve".split()
    return chunks(spark, [(f"v{i % 4}", "transcript" if i % 3 else "slide", i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)])


def test_scores_are_those_of_the_scan(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(some)
    for question in ("red Uber", "the of-the naïve", "nothing", "", '"red car" red'):
        want = {r["doc"]: r["bm25"] for r in search.bm25(some, question, id_col="doc").collect()}
        got = {r["doc"]: r["bm25"] for r in index.bm25(question).collect()}
        assert got == pytest.approx(want), question
    hit = index.search("red car", 3, F.col("video") == "v1").collect()
    want = sorted((r for r in search.bm25(some, "red car", id_col="doc").collect() if r["doc"] % 4 == 1), key=lambda r: (-r["bm25"], r["doc"]))[:3]
    assert [r["doc"] for r in hit] == [r["doc"] for r in want] and all(r["video"] == "v1" and 0 < r["score"] < 1 for r in hit)


def test_postings_move_once(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    odd = chunks(spark, [("v0", "slide", 900, None), ("v0", "slide", 901, " .\n"), (None, "slide", 902, "Über--a a\u00a0ß٣ 🙂 a")])
    rows = index._lines(some.unionByName(odd), "text")
    terms = index._terms(rows)
    assert "Exchange" not in plan_of(terms) and "Aggregate" not in plan_of(terms)
    want = {}
    for r in some.unionByName(odd).select("doc", F.regexp_extract_all(search.fold(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w")).collect():
        for i, w in enumerate(r["w"]):
            want.setdefault((r["doc"], len(r["w"]), w), []).append(i)
    assert {(r["doc"], r["length"], r["term"]): r["places"] for r in terms.collect()} == want and (902, 5, "a") in want
    assert {r["doc"]: r["length"] for r in rows.where("doc >= 900").collect()} == {900: 0, 901: 0, 902: 5}
    index.write(odd)
    assert index.postings().where("video = 'v0'").isEmpty() and index.corpus().first()["total"] == 3


def test_many_words_are_sorted_in_more_tasks(spark, some, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PART_WORDS", 4)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index._spread(0) == SPREAD and index._spread(16 * SPREAD + 1) == SPREAD + 1
    index.write(some)
    want = {r["doc"]: r["bm25"] for r in search.bm25(some, "red car", id_col="doc").collect()}
    assert {r["doc"]: r["bm25"] for r in index.bm25("red car").collect()} == pytest.approx(want)


def test_only_buckets_of_the_terms_are_read(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(some)
    buckets = {r[0] for r in spark.createDataFrame([("red",), ("car",)], "w string").select(bucket_of(F.col("w"), index.buckets)).collect()}
    df = index.bm25("red car")
    plan = plan_of(df)
    assert "PartitionFilters: [" in plan and "PushedFilters: [Or(EqualTo(term,car),EqualTo(term,red))" in plan.replace("Or(EqualTo(term,red),EqualTo(term,car))", "Or(EqualTo(term,car),EqualTo(term,red))") and "places" not in plan
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in index.postings().where(F.col("bucket").isin(*buckets)).inputFiles() if "bucket=" in f}
    scans = [m for m in plan.split("PartitionFilters: ")[1:] if "bucket" in m.split("PushedFilters")[0]]
    assert buckets <= read and scans and all(f"bucket#" in s and any(f"= {b})" in s for b in buckets) for s in scans)


def test_replaced_and_removed_owners_leave_nothing(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(some)
    fresh = chunks(spark, [("v1", "slide", 9000, "red red unicorn"), ("new", "slide", 9001, "red")])
    index.write(fresh)
    index.remove(spark.createDataFrame([("v2", "transcript")], "video string, kind string"))
    now = some.where("not (video = 'v1' and kind = 'slide') and not (video = 'v2' and kind = 'transcript')").unionByName(fresh)
    want = {r["doc"]: r["bm25"] for r in search.bm25(now, "red unicorn", id_col="doc").collect()}
    assert {r["doc"]: r["bm25"] for r in index.bm25("red unicorn").collect()} == pytest.approx(want)
    small = index.compact(str(tmp_path / "j"))
    assert {r["doc"]: r["bm25"] for r in small.bm25("red unicorn").collect()} == pytest.approx(want)
    assert small.spark.read.parquet(f"{small.path}/postings").count() == index.postings().count() < spark.read.parquet(f"{index.path}/postings").count()


def test_half_written_owners_are_not_seen(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(some)
    before = index.bm25("red").count()
    commit, index._commit = index._commit, lambda *_: None  # the job dies before its last step
    index.write(chunks(spark, [("v1", "slide", 9000, "red")]))
    index._commit = commit
    assert index.bm25("red").count() == before and index.bm25("red").where("doc = 9000").isEmpty()


def test_many_questions_equal_one_by_one(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(some)
    asked = [(1, "v0", "red car"), (2, "v1", "the of-the stone stone"), (3, "v1", ""), (4, "v9", "red"), (5, "v2", None), (6, "v3", "Naïve über-naïve")]
    got = index.search_many(spark.createDataFrame(asked, "question_id int, video string, question string"), 4)
    many = {(r["question_id"], r["rank"]): (r["doc"], round(r["bm25"], 9)) for r in got.collect()}
    want = {}
    for q, video, text in asked:
        for i, r in enumerate(index.search(text or "", 4, F.col("video") == video).collect(), 1):
            want[q, i] = (r["doc"], round(r["bm25"], 9))
    assert many == want and {q for q, _ in many} == {1, 2, 6}


def test_phrases_of_equals_terms_of(spark):
    texts = ["The RED car", 'a "b c" d-e', "", "  über  naïve ", " ".join(f"w{i}" for i in range(20)), "x x x-y x-y", "--"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(phrases_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [search.terms_of(t) for t in texts]


def test_vector_recall_pruning_and_exactness(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = VectorIndex.build(e, str(tmp_path / "v"), 16, "vec_id")
    x = np.array([r[0] for r in e.orderBy("vec_id").select("embedding").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    found = {}
    for r in index.search_many(asked, 20, "q", "vec_id").collect():
        found.setdefault(r["q"], set()).add(r["vec_id"])
    exact = {q: set(np.argsort(-(x @ x[q]), kind="stable")[:20].tolist()) for q in range(0, len(x), 50)}
    assert np.mean([len(found[q] & exact[q]) / 20 for q in exact]) >= 0.9
    one = index.search(x[100].tolist(), 20, "vec_id")
    assert {r["vec_id"] for r in one.collect()} == found[100] and "PartitionFilters: [cell" in plan_of(one)
    assert {r["vec_id"] for r in index.search(x[100].tolist(), 20, "vec_id", probes=None).collect()} == exact[100]


def test_vector_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "v"), 2, "vec_id", rounds=2)
    assert index.rows().count() == 7
    assert index.search([1.0, 0.0], 1, "vec_id", None).where("score > 0.9").first()["vec_id"] in (4, 5)
    assert fit(df.where("false"), 3, "vec_id").shape == (1, 1)
    with pytest.raises(ValueError):
        fit(df, 0, "vec_id")


def test_tools_search_for_themselves(spark, some, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(some)
    rows = tools.state(spark.createDataFrame([(1, "v1", "red car", "river"), (2, "v2", "blue dog", ""), (3, "none", "red", None)], "session int, video string, question string, word string"))
    got = {r["session"]: r for r in tools.TOOLS["retrieve_transcript_evidence"](rows, "session", index, some, "transcript", 5).collect()}
    want = {r["doc"] for r in index.search("red car", 5, (F.col("video") == "v1") & (F.col("kind") == "transcript")).collect()}
    assert {int(t["t_start"] / 3) for t in got[1]["transcripts"]} == want and len(got[2]["transcripts"]) == 5 and got[3]["transcripts"] == []
    assert all(t["kind"] == "transcript" for t in got[1]["transcripts"])
    slides = {r["session"]: r["slides"] for r in tools.search_texts(rows, "session", index, some, "slide", 5).collect()}
    assert slides[1] and all(t["kind"] == "slide" for t in slides[1])
    heard = {r["session"]: r["transcripts"] for r in tools.search_keyword(rows, "session", "word", some, 3).collect()}
    assert len(heard[1]) == 3 and all("river" in t["text"] for t in heard[1]) and heard[2] == heard[3] == []
    both = index.search_many(rows.select("session", "video", "question"), 5, "session").select("session", "doc", (6 - F.col("rank")).alias("rank"))
    fused = {r["session"]: r["transcripts"] for r in tools.search_texts(rows, "session", index, some, "transcript", 3, dense=both).collect()}
    assert len(fused[1]) == 3


def test_blocks_equal_the_plain_join(spark, monkeypatch):
    """Small blocks, copies that tie, odd vectors, times that repeat and scenes that overlap."""
    from lumenframe.functions.numeric import cosine
    from lumenframe.operators import nearest

    monkeypatch.setattr(nearest, "PIECE", 7)
    monkeypatch.setattr(nearest, "TILE", 3)
    rng = random.Random(8)
    some = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(12)] + [[float("nan"), 1.0, 0.0], [0.0, 0.0, 0.0]]
    frames = spark.createDataFrame([(rng.choice("vw"), float(rng.randint(0, 30)), rng.choice(some)) for _ in range(90)], "video string, ts double, embedding array<double>")
    scenes = spark.createDataFrame([(rng.choice("vw"), float(i), i + float(rng.randint(0, 90)), rng.choice(some)) for i in range(60)], "video string, start double, end double, embedding array<double>")
    asked = spark.createDataFrame([(i, rng.choice("vwx"), rng.choice(some[:12]), rng.randint(1, 5), rng.randint(1, 6)) for i in range(25)], "q int, video string, query array<double>, n_scenes int, n_frames int")
    pairs = asked.join(frames, "video").withColumn("score", cosine("embedding", "query")).select("q", "ts", "score", "n_frames")
    rank = lambda *c: F.row_number().over(search.W.partitionBy("q").orderBy(F.col("score").desc(), *c))
    once = pairs.groupBy("q", "n_frames", "ts").agg(F.max("score").alias("score")).withColumn("r", rank("ts"))
    got = nearest.best_in_pieces(asked, frames, "video", "q", "query", "n_frames", "embedding", ["ts"], once=True, odd=float("nan")).groupBy("q", "ts").agg(F.max("score").alias("score"))
    assert sorted(map(repr, got.withColumn("r", rank("ts")).join(asked.select("q", "n_frames"), "q").where("r <= n_frames").select("q", "ts", "score").collect())) == sorted(map(repr, once.where("r <= n_frames").select("q", "ts", "score").collect()))
    gates, hits = search.two_stage_many(asked, scenes, frames, "q")
    near = asked.join(scenes, "video").withColumn("score", cosine("embedding", "query")).withColumn("r", rank("start", "end")).where("r <= n_scenes")
    assert sorted(map(repr, gates.select("q", "start", "end", "score", "rank").collect())) == sorted(map(repr, near.select("q", "start", "end", "score", F.col("r").alias("rank")).collect()))
    inside = pairs.join(near.select("q", "start", "end"), "q").where("ts between start and end").select("q", "ts").distinct()
    first = pairs.join(inside, ["q", "ts"]).withColumn("r", rank("ts")).where(F.col("r") <= search.scene_share(F.col("n_frames"), F.lit(True))).withColumn("tier", F.lit(0))
    both = first.unionByName(once.where("r <= 3 * n_frames").withColumn("tier", F.lit(1)))
    both = both.groupBy("q", "ts", "n_frames").agg(F.min(F.struct("tier", "r")).alias("k")).withColumn("p", F.row_number().over(search.W.partitionBy("q").orderBy("k"))).where("p <= n_frames")
    assert sorted(map(repr, hits.select("q", "ts", "rank").collect())) == sorted(map(repr, both.select("q", "ts", F.col("p").alias("rank")).collect()))
    assert "FlatMapCoGroupsInArrow" in plan_of(hits) and "zip_with" not in plan_of(got)


def test_a_vector_of_another_width_scores_zero(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [-1.0, 0.0]), (4, None), (5, [float("inf"), 0.0])], "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "v"), 2, "vec_id", rounds=2)
    got = index.search_many(spark.createDataFrame([(0, [2.0, 0.0])], "q int, query array<double>"), 9, "q", "vec_id", probes=None)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (4, 0.0), (5, 0.0), (3, -1.0)]


def test_documents_of_equal_terms_tie(spark, tmp_path):
    """Copies have equal scores whatever order their terms' scores are added in, so they come by their names."""
    rng, words = random.Random(3), [f"w{i}" for i in range(11)]
    rows = [("v", "transcript", i, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for i in range(60)]
    rows += [("v", "transcript", 100 * c + i, rows[i][3]) for c in (1, 2, 3) for i in range(60)]
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(chunks(spark, rows).repartition(9))
    asked = spark.createDataFrame([(q, "v", " ".join(rng.sample(words, 11))) for q in range(12)], "question_id int, video string, question string")
    got = {}
    for r in index.search_many(asked, 240, "question_id").collect():
        got.setdefault((r["question_id"], r["doc"] % 100), []).append((r["rank"], r["doc"], r["bm25"]))
    assert all(len({s for _, _, s in g}) == 1 and [d for _, d, _ in sorted(g)] == sorted(d for _, d, _ in g) for g in got.values())


def test_hits_of_many_questions_stay_in_their_tasks(spark, tmp_path, monkeypatch):
    """Pieces and blocks of any size give the same rows, and what leaves a group is a question's best, not its hits."""
    rng, words = random.Random(4), [f"w{i}" for i in range(9)]
    rows = [(f"v{i % 2}", rng.choice(["transcript", "slide"]), i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(v, k, 200 + i, t) for v, k, i, t in rows[:40]]
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(chunks(spark, rows))
    asked = [(q, rng.choice(["v0", "v1", "v7", None]), rng.choice([" ".join(rng.sample(words, rng.randint(1, 4))), "w1-w2 w3", "none"])) for q in range(50)]
    df = spark.createDataFrame(asked, "question_id int, video string, question string")
    many = lambda d: sorted(tuple(r) for r in index.search_many(d, 4).select("question_id", "video", "kind", "doc", F.round("bm25", 9), "rank").collect())
    whole, all_over = many(df), many(df.drop("video"))
    hits = {(q, r["doc"]) for q, v, t in asked[:12] for r in index.bm25(t, F.col("video") == (v or "")).collect()}
    best = index.search_many(df, 4)
    assert "FlatMapCoGroupsInArrow" in plan_of(best) and len(hits) > 12 * 4
    want = {q: [r["doc"] for r in index.search(t, 4, F.col("video") == (v or "")).collect()] for q, v, t in asked[:12]}
    assert {q: [r[3] for r in sorted((x for x in whole if x[0] == q), key=lambda x: x[5])] for q in want} == want
    monkeypatch.setattr(textindex, "PIECE_WORDS", 150)
    monkeypatch.setattr(textindex, "BLOCK", 7)
    assert many(df) == whole and many(df.drop("video")) == all_over and {r[1] for r in all_over} == {"v0", "v1"}


def test_a_write_does_not_shuffle_postings(spark, some, tmp_path, monkeypatch):
    """Postings are several times their texts; each task writes its own part, as many as the words ask for."""
    moved = []
    frame = type(some)
    monkeypatch.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: moved.append(self.columns) or f(self, *a))
    index = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    index.write(some)
    assert not moved
    small = index.compact(str(tmp_path / "j"))
    assert moved and small.search("red car", 5).collect() == index.search("red car", 5).collect()
