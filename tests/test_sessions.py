"""Keyed stream state equals the batch forms however a stream is cut; the agent's loop; joins and caps over tasks."""

import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators import intervals as iv
from lumenframe.operators import merge, sampling
from lumenframe.operators.textindex import TextIndex
from lumenframe.plans import agent, tools
from lumenframe.plans import evidence as ev
from lumenframe.sources import files
from lumenframe.streaming import chat, sessions, state

EVENT = "session string, pos long, kind string, data string"


def chat_events(rng, n):
    rows = []
    for s in range(n):
        kinds, pos = [], 0
        for _ in range(rng.randint(1, 12)):
            kind = rng.choice(["token", "token", "token", "tool", "plan_end", "error"])
            data = {"token": {"text": rng.choice(["a", "bc ", ""])}, "tool": {"updates": [{"frames": [1] * rng.randint(0, 2)}]}, "plan_end": {"tool_calls": rng.choice([[], ["x"]])}, "error": {"detail": "no"}}[kind]
            kinds.append((f"s{s}", pos, kind, json.dumps(data)))
            pos += 1
        rows += [*kinds, (f"s{s}", pos, "end", json.dumps({"last_answer": rng.choice(["", "last"])}))]
    return rows


def cut(spark, rows, schema, path, parts):
    """Append rows as files in ``parts`` goes."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_chat_stream_cut_anywhere_and_restarted_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = chat_events(rng, 12)
    want = sorted(map(tuple, chat.fold_events(spark.createDataFrame(rows, EVENT)).collect()))
    mixed = rng.sample(rows, len(rows)) + rng.sample(rows, 10)  # out of order, and some twice
    path, third = str(tmp_path / "in"), len(mixed) // 3
    cut(spark, rows, EVENT, path, [mixed[:third], mixed[third : 2 * third]])
    read = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    first = sessions.run_to_table(sessions.fold_stream(read()), str(tmp_path / "out"), str(tmp_path / "cp")).count()
    cut(spark, rows, EVENT, path, [mixed[2 * third :]])
    got = sessions.run_to_table(sessions.fold_stream(read()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == want and 0 < first < len(want)


def test_registry_stream_equals_the_batch(spark, tmp_path):
    rng, rows = random.Random(5), []
    for s in ("a", "b"):
        for pos in range(30):
            t = float(rng.randint(0, 50))
            delta = {"op": rng.choice(["add", "update"]), "id": f"p{rng.randint(0, 6)}", "first_seen_t": t, "last_seen_t": t, "attributes": [str(pos)], "attributes_add": [str(pos)], "evidence_frames": [t]}
            rows.append((s, pos, json.dumps(delta)))
    want = {s: state.fold_registry([json.loads(d) for x, _, d in rows if x == s], 4) for s in "ab"}
    mixed, schema, path = rng.sample(rows, len(rows)), "session string, pos long, delta string", str(tmp_path / "in")
    cut(spark, rows, schema, path, [mixed[:25], mixed[25:]])
    stream = sessions.registry_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 4)
    stream.writeStream.format("memory").queryName("registries").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("registries").groupBy("session").agg(F.max("upto").alias("upto"), F.max_by("registry", "upto").alias("r")).collect()
    assert {r["session"]: json.loads(r["r"]) for r in got} == want and {r["upto"] for r in got} == {30}


def test_progress_feed_replays_once_and_ends(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    progress = [("v", at(1), "stage1", "1"), ("v", at(3), "stage2", "2"), ("v", at(5), "done", "3"), ("v", at(8), "stage1", "4"), ("w", at(2), "failed", "5"), ("z", at(59), "x", "9")]
    subs = [("v", at(2), "early", False), ("v", at(4), "mid", False), ("v", at(4), "gone", False), ("v", at(5), "gone", True), ("v", at(6), "late", False), ("v", at(0), "first", False), ("w", at(9), "after", False), ("none", at(1), "alone", False)]
    p, s = str(tmp_path / "p"), str(tmp_path / "s")
    spark.createDataFrame(progress, "video string, t string, stage string, item string").selectExpr("video", "timestamp(t) ts", "stage", "item").coalesce(1).write.parquet(p)
    spark.createDataFrame(subs, "video string, t string, subscriber string, leaves boolean").selectExpr("video", "timestamp(t) ts", "subscriber", "leaves").coalesce(1).write.parquet(s)
    stream = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = sessions.run_to_table(sessions.feed_stream(stream(p), stream(s)), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    feed = {}
    for r in sorted(got, key=lambda r: r["at"]):
        feed.setdefault(r["subscriber"], []).append((r["event"], r["item"]))
    assert feed == {
        "first": [("stage", "1"), ("stage", "2"), ("done", "3")], "early": [("stage", "1"), ("stage", "2"), ("done", "3")], "mid": [("stage", "2"), ("done", "3")], "gone": [("stage", "2"), ("done", "3")],
        "late": [("done", "3")], "after": [("error", "5")],
    }


def test_checkpoint_store(spark, tmp_path):
    store = sessions.CheckpointStore(spark, str(tmp_path / "c"), "a", "b")
    rows = lambda *r: spark.createDataFrame(list(r), "thread string, step int, a string, b int")
    store.put(rows(("t", 1, "x", 1), ("t", 2, None, 2), ("u", 1, "y", None)))
    store.put(rows(("t", 3, "z", None), ("t", 2, None, 5)))  # step 2 again
    assert sorted(map(tuple, store.history().collect())) == [("t", 1, "x", 1), ("t", 2, "x", 5), ("t", 3, "z", 5), ("u", 1, "y", None)]
    assert {tuple(r) for r in store.at().collect()} == {("t", 3, "z", 5), ("u", 1, "y", None)}
    assert {tuple(r) for r in store.at(2).collect()} == {("t", 2, "x", 5), ("u", 1, "y", None)}
    store.fork("t", 2, "t2")
    assert ("t2", 2, "x", 5) in {tuple(r) for r in store.at().collect()}


# the agent


def test_agent_with_its_own_tools(spark, tmp_path):
    chunks = spark.createDataFrame([("v", "transcript", i, t, i * 5.0, i * 5.0 + 4) for i, t in enumerate(["the red car stops", "a dog barks", "rain falls", "the red car leaves"])], "video string, kind string, doc long, text string, t_start double, t_end double")
    index = TextIndex(spark, str(tmp_path / "i"))
    index.write(chunks)
    rows = tools.state(spark.createDataFrame([(1, "v", "What does the red car do?"), (2, "none", "Where is the red car?")], "session int, video string, question string"))
    said = F.when(F.size("transcripts") > 0, F.concat(F.lit("It stops [TRANSCRIPT:t="), F.format_number(F.col("transcripts")[0]["t_start"], 1), F.lit("-"), F.format_number(F.col("transcripts")[0]["t_end"], 1), F.lit("]")))
    own = {
        "retrieve_transcript_evidence": lambda r: tools.search_texts(r, "session", index, chunks, "transcript", 2), agent.ASSESS: tools.assess,
        agent.ANSWER: lambda r: tools.answer(r.withColumn("said", said), "said"), agent.VERIFY: tools.ground,
    }
    plan = lambda r: F.when(F.col("last") == agent.ASSESS, agent.FINAL).otherwise(agent.rule_planner(r))
    got = {r["session"]: r for r in agent.run(rows, plan, own, F.size("transcripts") > 0).collect()}
    assert got[1]["steps"] == ["retrieve_transcript_evidence", agent.ASSESS, agent.ANSWER, agent.VERIFY] and got[1]["ended"] == "grounded" and got[1]["answer"].startswith("It stops [TRANSCRIPT:t=")
    assert got[2]["ended"] == agent.FINAL and got[2]["answer"] is None


def test_agent_caps_forced_answers_and_unknown_tools(spark):
    rows = spark.createDataFrame([(i, i) for i in range(4)], "session int, kind int")
    planner = lambda r: F.when(F.col("kind") == 0, "spin").when(F.col("kind") == 1, "nothing").when(F.col("kind") == 2, agent.FINAL).otherwise("spin")
    own = {"spin": lambda r: r, agent.ANSWER: lambda r: r.withColumn("answer", F.lit("so")), agent.VERIFY: lambda r: r.withColumn("grounded", F.lit(False))}
    got = {r["session"]: r for r in agent.run(rows, planner, own, F.col("kind") == 3, most=3).collect()}
    assert (got[0]["ended"], got[0]["calls"]) == ("cap", 3) and got[1]["ended"] == "unknown_tool" and (got[2]["ended"], got[2]["calls"]) == ("final", 0)
    assert (got[3]["ended"], got[3]["steps"], got[3]["answer"]) == ("draft", ["spin"] * 3 + [agent.ANSWER], "so")
    assert agent.run(rows.where("false"), planner, own, F.lit(True)).isEmpty()


# many tasks


def test_nearest_spread_equals_nearest(spark):
    rng = random.Random(6)
    gold = spark.createDataFrame([(rng.choice(["hot", "hot", "hot", "a", "b", "only"]), float(rng.randint(0, 300))) for _ in range(400)], "k string, gold_t double")
    found = spark.createDataFrame([(rng.choice(["hot", "hot", "a", "b", "c"]), float(rng.randint(0, 300))) for _ in range(300)], "k string, t double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = iv.nearest_spread(gold, found, "k")
        assert rows.rdd.getNumPartitions() > 1
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, iv.nearest(gold, found, "k").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert iv.nearest_spread(gold.where("false"), found, "k").isEmpty()


def test_capped_rows_equal_arrays(spark):
    rng, kinds = random.Random(7), ["transcript", "slide", ""]
    rows = [(rng.randint(0, 2), i, rng.uniform(0, 30), rng.choice("xy"), rng.choice(kinds), float(rng.randint(0, 9)), rng.choice(["t", "u", " ", None]), float(rng.randint(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "s int, i int, timestamp double, source string, kind string, t_start double, text string, score double").withColumn("t_end", F.col("t_start") + 1)
    listed = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct(*c).alias("x")))), lambda v: v["x"])
    a = df.withColumn("hypothesis", F.lit(None).cast("string")).groupBy("s").agg(listed("timestamp", "source", "hypothesis").alias("f"), listed("kind", "t_start", "t_end", "text", "score").alias("t"))
    want = a.select("s", F.explode(ev.merge_frames(ev.empty(ev.FRAME), "f", 12)).alias("f")).select("s", "f.timestamp", "f.source")
    assert sorted(map(tuple, merge.capped_frames(df, "s", "timestamp", "i", 12, "source").collect())) == sorted(map(tuple, want.collect()))
    for limit in (None, 20):
        want = a.select("s", F.explode(ev.merge_texts(ev.empty(ev.TEXT), "t", limit)).alias("t")).select("s", "t.*")
        assert sorted(map(repr, merge.capped_texts(df, "s", "i", limit).collect())) == sorted(map(repr, want.collect()))


def test_allocation_and_slides(spark):
    shares = lambda n, k: {r["s"]: (r["size"], r["share"]) for r in sampling.allocate(spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s")).select("s", F.explode(F.sequence(F.lit(1), F.col("s")))), "s", n).collect()}
    got = shares(10, 6)
    assert sum(s for _, s in got.values()) == 10 and all(1 <= s <= z for z, s in got.values())
    assert all(s == 1 for _, s in shares(2, 5).values())  # more strata than places
    assert {z: s for z, s in shares(1000, 4).values()} == {1: 1, 2: 2, 3: 3, 4: 4}
    rows = spark.createDataFrame([("v", 0, " "), ("v", 1, " a "), ("v", 2, None), ("v", 3, "b")], "video string, n int, text string").withColumn("timestamp", F.col("n") * 2.0)
    assert [(r["chunk_id"], r["text"], r["t_start"], r["t_end"], r["source"], r["slide_id"], r["filename"]) for r in iv.chunk_slides(rows, "video", "n").collect()] == [("slide_00001", "a", 2.0, 2.0, "rapidocr", 1, ""), ("slide_00003", "b", 6.0, 6.0, "rapidocr", 3, "")]


def test_ingest_counts_and_files(spark, tmp_path):
    cases = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "case_id string")
    manifest = spark.createDataFrame([("a", "va"), ("b", "vb"), ("c", "vc"), ("x", "va"), ("d", "vd")], "case_id string, video string")
    there = spark.createDataFrame([("va", "/va", "ia"), ("vb", "/vb", "ib"), ("vd", "/vd", None)], "video string, path string, content_id string")
    status = spark.createDataFrame([("ia", "done")], "content_id string, status string")
    got = files.ingest(cases, manifest, there, status, str(tmp_path / "o"), F.lit(None).cast("string"))
    assert got == {"rebound": 2, "processed": 1, "skipped": 3}
    rows = spark.read.parquet(str(tmp_path / "o"))
    assert {r["case_id"] for r in rows.where("kept = 'true'").collect()} == {"a", "b"} and {r["reason"] for r in rows.where("kept = 'false'").collect()} == {"no_case", "file_missing", "hash_failed"}
    failed = files.ingest(cases, manifest, there, status, str(tmp_path / "p"), F.lit("broken"))
    assert failed == {"rebound": 2, "processed": 0, "skipped": 4}
    assert {r["case_id"] for r in spark.read.parquet(str(tmp_path / "p")).where("kept = 'true'").collect()} == {"a", "b"}
    assert files.ingest(cases, manifest, there, status, str(tmp_path / "q"), F.lit("broken"), skip=True) == {"rebound": 2, "processed": 0, "skipped": 3}


def test_means_do_not_hang_on_the_cut(spark):
    """Sums of doubles in any other order than the rows' can miss a tie, and the centre is rounded."""
    from lumenframe.queries.tools import mean_of

    rng, rows = random.Random(9), []
    for u in range(40):
        v = [round(rng.uniform(0, 100), 2) for _ in range(60)]
        rows += [(u, i, x) for i, x in enumerate(v)]
    want = {}
    for u, _, x in rows:
        want[u] = want.get(u, 0.0) + x
    mixed = spark.createDataFrame(rng.sample(rows, len(rows)), "user_id int, i int, v double").repartition(7)
    got = {r["user_id"]: (r["n"], r["mean"]) for r in mean_of(mixed, "user_id", "v", "i").collect()}
    assert got == {u: (60, t / 60) for u, t in want.items()}
    odd = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (2, 0, None)], "user_id int, i int, v double")
    assert sorted(map(tuple, mean_of(odd, "user_id", "v", "i").collect())) == [(1, 3, 2.0), (2, 1, None)]


class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self, *_):
        store = self

        class State:
            value = None

            def get(self):
                store.calls += 1
                return iter(list(self.value or [])) if self.many else self.value

            def update(self, v):
                store.calls += 1
                self.value = v

            def put(self, v):
                self.update(list(v))

            def appendList(self, v):
                self.update([*(self.value or []), *v])

            def appendValue(self, v):
                self.appendList([v])

            def clear(self):
                self.update(None)

        return State()

    def getValueState(self, *a):
        s = self._state()
        s.many = False
        return s

    def getListState(self, *a):
        s = self._state()
        s.many = True
        return s

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_feed_asks_the_store_seldom():
    store, feed = Store(), sessions.Feed(1000)
    feed.init(store)
    rows = [{"at": i * 1_000_000, "rank": int(i == 3), "item": str(i), "stage": "s", "subscriber": "me" if i == 3 else None} for i in range(30)]
    assert list(feed.handleInputRows(("v",), iter(rows), At(-1))) == [] and store.timers == {1000}
    out = list(feed.handleExpiredTimer(("v",), At(20_500), At(1000)))  # the watermark has passed twenty spans
    assert [r["item"] for r in out] == ["2", *map(str, range(4, 20))] and 21_000 in store.timers and store.calls <= 12


def test_early_chat_rows_ask_the_store_seldom():
    import pandas as pd

    store, fold = Store(), sessions.ChatFold()
    fold.init(store)
    batch = lambda a, b: iter([pd.DataFrame([(i, "token", '{"text": "x"}') for i in range(a, b)], columns=["pos", "kind", "data"])])
    assert list(fold.handleInputRows(("s",), batch(1, 40), None)) == [] and store.calls <= 3
    list(fold.handleInputRows(("s",), batch(0, 1), None))
    assert fold.at == 40 and store.calls <= 10


def test_a_mean_beside_a_tie_is_rounded_as_in_sql(spark, tmp_path):
    """A mean of 57.050000000000004 is 570.5 tenths, so its centre is 57.0 in SQL; many means here lie a bit beside a tie."""
    import duckdb

    from lumenframe.catalog import ORACLES, QUERIES

    rng, rows = random.Random(6), []
    for u in range(200):
        v = [rng.randint(0, 8000) for _ in range(19)]
        v.append((10 * rng.randint(300, 600) + 5) * 20 - sum(v))
        rows += [(20 * u + i, u, x / 100) for i, x in enumerate(v)]
    rows += [(9000 + i, 500 + i, x) for i, x in enumerate([57.050000000000004, 1.6500000000000001, 0.8500000000000001, 3.6500000000000004])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("*", "'view' AS event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET threads=1")  # it adds up in the order of the rows
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["segment_focus"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(ORACLES["segment_focus"]).fetchall()) and len(got) == 204
