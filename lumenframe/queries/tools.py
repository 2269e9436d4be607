"""Session evidence, agent tools, parsing and chat queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import dialogue as dl
from ..operators import merge
from ..operators.sampling import per_group
from ..plans import evidence as ev
from ..plans import tools
from ..runtime import scratch
from ..streaming import chat
from ..streaming import sessions as sessions_of
from .registry import ORACLES, query, read

def items(spark, sf):
    """Events of a user as frames, scenes and texts of a session, in order of their ids."""
    e, v, i = read(spark, sf, "events"), F.col("value").cast("double"), F.col("event_id")
    return e.select(
        "user_id", i.alias("i"), v.alias("timestamp"), F.col("event_type").alias("source"), F.lit(None).cast("string").alias("hypothesis"), F.floor(v).cast("double").alias("start"), (F.floor(v) + 2).cast("double").alias("end"),
        F.col("event_type").alias("caption"), F.when(i % 2 == 0, "transcript").otherwise("slide").alias("kind"), F.floor(v / 10).cast("double").alias("t_start"), (F.floor(v / 10) + 1).cast("double").alias("t_end"),
        F.concat_ws(" ", "event_type", F.lit("of red car number"), (i % 4).cast("string")).alias("text"), (i % 3).cast("double").alias("score"),
    )


def mean_of(rows, by: str, value: str, order: str):
    """``(by, n, mean)``: the mean is added up in the order of ``order``, so it doesn't hang on how a table is cut into files and tasks."""
    upto = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # sums run over the rows in order and each is one row's: no list of a group is held
    run = rows.select(by, order, F.sum(value).over(upto).alias("_s"), F.count(value).over(upto).alias("_c"))
    return run.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.when(F.col("_c") > 0, F.col("_s") / F.col("_c")), order).alias("mean"))


def packed(rows, by: str, name: str, order: list[str], *fields: str):
    """``(by, name)``: rows as one array a session, in order. The rows were capped or merged before."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_x"))))["_x"].alias(name))


def sessions(spark, sf):
    """A session a user: frames capped, scenes and texts merged before they become arrays."""
    e = items(spark, sf)
    frames = packed(merge.capped_frames(e, "user_id", "timestamp", "i", 36, "source", "hypothesis").withColumnRenamed("at", "timestamp"), "user_id", "new_frames", ["timestamp"], "timestamp", "source", "hypothesis")
    scenes = packed(merge.capped_scenes(e, "user_id", "start", "end", "i", "caption"), "user_id", "new_scenes", ["start", "end"], "start", "end", "caption")
    texts = packed(merge.capped_texts(e, "user_id", "i", None), "user_id", "new_texts", ["kind", "t_start", "t_end", "text"], "kind", "t_start", "t_end", "text", "score")
    return frames.join(scenes, "user_id").join(texts, "user_id")


_ITEMS = "e AS (SELECT user_id, event_id AS i, value::DOUBLE AS v, event_type AS k FROM events)"


@query("merge_frames_state", f"""WITH {_ITEMS}, f AS (SELECT user_id, round_even(v, 1) AS t, arg_min(k, i) AS source FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM f),
w AS (SELECT DISTINCT user_id, n, CASE WHEN n <= 12 THEN j ELSE least(n - 1, round_even(j * ((n - 1) / 11.0), 0)::BIGINT) END AS r FROM (SELECT DISTINCT user_id, n FROM n), range(12) AS g(j) WHERE n > 12 OR j < n)
SELECT user_id, t, source FROM n JOIN w USING (user_id, n, r)""")
def merge_frames(spark, sf):
    return merge.capped_frames(items(spark, sf), "user_id", "timestamp", "i", 12, "source").select("user_id", F.col("at").alias("t"), "source")


@query("merge_scenes_state", f"WITH {_ITEMS} SELECT user_id, floor(v)::DOUBLE AS start, floor(v)::DOUBLE + 2 AS end_, arg_min(k, i) AS caption FROM e GROUP BY ALL")
def merge_scenes(spark, sf):
    return merge.capped_scenes(items(spark, sf), "user_id", "start", "end", "i", "caption").select("user_id", "start", F.col("end").alias("end_"), "caption")


_TEXTS = f"""{_ITEMS}, t AS (SELECT user_id, i, CASE WHEN i % 2 = 0 THEN 'transcript' ELSE 'slide' END AS kind, floor(v / 10)::DOUBLE AS t_start, k || ' of red car number ' || i % 4 AS text, (i % 3)::DOUBLE AS score FROM e),
b AS (SELECT user_id, kind, t_start, text, max(score) AS score FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind, t_start) AS n, count(*) OVER (PARTITION BY user_id ORDER BY kind, t_start) AS upto FROM b)"""


@query("merge_texts_state", f"WITH {_TEXTS} SELECT user_id, kind, t_start, text, score FROM b")
def merge_texts(spark, sf):
    return merge.capped_texts(items(spark, sf), "user_id", "i", None).select("user_id", "kind", "t_start", "text", "score")


@query("merge_texts_cap", f"WITH {_TEXTS} SELECT user_id, least(20, count(*)) AS n, max(t_start) FILTER (n <= 20) AS last_start, min(kind) AS kind FROM r GROUP BY user_id")
def merge_texts_cap(spark, sf):
    t = merge.capped_texts(items(spark, sf), "user_id", "i")
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_start").alias("last_start"), F.min("kind").alias("kind"))


QUESTION = "Which is listed first?\n(a) the view of a red car\n(b) a purchase of the red car number 3\n(c) a blue boat\n\nCandidates:\nA) (b)(a)\nB) (a)(b)\n"
_CANDIDATES = "[('a', ['view', 'red', 'car']), ('b', ['purchase', 'red', 'car', 'number']), ('c', ['blue', 'boat'])]"


@query("build_timeline", f"""WITH {_ITEMS}, c AS (SELECT unnest({_CANDIDATES}) AS c), x AS (SELECT user_id, c[1] AS label, floor(v / 10)::DOUBLE AS t, len(list_filter(c[2], lambda w: contains(k || ' of red car number ' || i % 4, w))) AS hits, len(c[2]) AS n FROM e, c WHERE i % 2 = 0),
b AS (SELECT user_id, label, max(hits) AS hits, min(t) FILTER (hits = m) AS t FROM (SELECT *, max(hits) OVER (PARTITION BY user_id, label) AS m FROM x) WHERE hits >= CASE WHEN n <= 2 THEN 1 ELSE 2 END GROUP BY ALL),
g AS (SELECT user_id, max(t) FILTER (label = 'a') AS a, max(t) FILTER (label = 'b') AS b FROM b GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, CASE WHEN a IS NULL AND b IS NULL THEN '' WHEN b IS NULL THEN 'a' WHEN a IS NULL THEN 'b' WHEN a <= b THEN 'a,b' ELSE 'b,a' END AS inferred_order, a AS a_t, b AS b_t, false AS complete FROM u LEFT JOIN g USING (user_id)""")
def build_timeline(spark, sf):
    s = sessions(spark, sf).select("user_id", F.lit(QUESTION).alias("question"), F.filter("new_texts", lambda t: t["kind"] == "transcript").alias("transcripts"))
    t = tools.build_timeline(tools.state(s), expand=False)
    at = lambda label: F.try_element_at(F.filter("candidates", lambda c: c["label"] == label), F.lit(1))["t"]
    return t.select("user_id", F.array_join("inferred_order", ",").alias("inferred_order"), at("a").alias("a_t"), at("b").alias("b_t"), F.col("recommended_option").isNotNull().alias("complete"))


@query("segment_focus", """WITH n AS (SELECT user_id, count(*) % 5 + 1 AS h, round_even(avg(value::DOUBLE), 1) AS c FROM events GROUP BY user_id), w AS (SELECT user_id, round_even(least(greatest(0.0, c - h), least(60.0, c + h)), 2) AS start, round_even(least(60.0, c + h), 2) AS end_ FROM n)
SELECT *, least(12, len(list_filter(range(0, 60), lambda t: t >= start AND t <= end_))) AS frames, CASE WHEN frames > 0 THEN 'answer_with_evidence' ELSE 'retrieve_video_evidence' END AS next_action FROM w""")
def segment_focus(spark, sf):
    n = mean_of(items(spark, sf), "user_id", "timestamp", "i").withColumnRenamed("mean", "c")
    # as the SQL rounds a double: bround() goes by its digits, where 57.050000000000004 is no tie, but times ten it is 570.5
    s = tools.state(n.select("user_id", (F.rint(F.col("c") * 10) / 10).alias("center"), (F.col("n") % 5 + 1).cast("double").alias("half"), F.lit(60.0).alias("duration"), F.transform(F.sequence(F.lit(0), F.lit(59)), lambda t: t.cast("double")).alias("dense"), F.lit("seen").alias("observation")))
    t = tools.segment_focus(s, "center", "half", "observation")
    return t.select("user_id", F.col("focus.start").alias("start"), F.col("focus.end").alias("end_"), F.size("frames").cast("long").alias("frames"), F.col("required_next_action").alias("next_action"))


@query("stitched_windows", f"""WITH {_ITEMS}, w AS (SELECT user_id, i, round_even(least(v, 50.0), 2) AS a, round_even(greatest(v, 50.0), 2) AS b FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM w)
SELECT user_id, a AS start, b AS end_, CASE WHEN m > 4 THEN 'truncated to 4 windows' END AS warning FROM r WHERE n <= 4""")
def stitched(spark, sf):
    # a fifth window only tells that there are more, so five a session are enough
    w = items(spark, sf).select("user_id", F.bround(F.least("timestamp", F.lit(50.0)), 2).alias("start"), F.bround(F.greatest("timestamp", F.lit(50.0)), 2).alias("end"))
    few = per_group(w, "user_id", 5, "start", "end")
    windows, warning = ev.stitched_windows(F.col("w"))
    s = packed(few, "user_id", "w", ["start", "end"], "start", "end").select("user_id", F.explode(windows).alias("w"), warning.alias("warning"))
    return s.select("user_id", "w.start", F.col("w.end").alias("end_"), "warning")


@query("stitched_counts", f"""WITH {_ITEMS}, w AS (SELECT user_id, floor(v)::DOUBLE AS a, floor(v)::DOUBLE + 3 AS b FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) = 1) SELECT user_id, a AS start, b AS end_, (least(b, 99) - least(a, 100) + 1)::BIGINT AS frame_count FROM w""")
def stitched_counts(spark, sf):
    first = items(spark, sf).groupBy("user_id").agg(F.min_by("start", "i").alias("start"))
    one = F.array(F.struct("start", (F.col("start") + 3).alias("end")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda t: t.cast("double"))
    s = first.select("user_id", one.alias("w"), dense.alias("dense"))
    _, counts = ev.stitched_frames(F.col("dense"), F.col("w"))
    return s.select("user_id", F.explode(counts).alias("c")).select("user_id", "c.start", F.col("c.end").alias("end_"), F.col("c.frame_count").cast("long").alias("frame_count"))


@query("align_audiovisual", f"""WITH {_ITEMS}, t AS (SELECT user_id, avg(v) AS t FROM e GROUP BY user_id), x AS (SELECT e.*, greatest(t - 4, 0) AS lo, t + 4 AS hi FROM e JOIN t USING (user_id))
SELECT user_id, (SELECT count(DISTINCT round_even(v, 1)) FROM x y WHERE y.user_id = t.user_id AND v BETWEEN lo AND hi) AS n_frames,
 (SELECT count(*) FROM (SELECT DISTINCT floor(v / 10), k, i % 4 FROM x y WHERE y.user_id = t.user_id AND i % 2 = 0 AND floor(v / 10) <= hi AND floor(v / 10) + 1 >= lo)) AS n_transcripts FROM t""")
def align(spark, sf):
    is_ = lambda k: F.filter("new_texts", lambda t: t["kind"] == k)
    e = items(spark, sf)
    mean = mean_of(e, "user_id", "timestamp", "i").select("user_id", F.col("mean").alias("t"))
    # only what lies near the time is gathered; the tool's own cap comes after
    near = e.join(mean, "user_id").where(F.col("timestamp").between(F.greatest(F.col("t") - 4, F.lit(0.0)), F.col("t") + 4))
    at = mean.join(packed(merge.capped_frames(near, "user_id", "timestamp", "i", 1 << 20, "timestamp"), "user_id", "times", ["at"], "timestamp"), "user_id", "left").withColumn("times", F.coalesce("times.timestamp", F.array().cast("array<double>")))
    s = tools.state(sessions(spark, sf).join(at, "user_id").select("user_id", "t", "times", is_("transcript").alias("heard"), is_("slide").alias("seen")))
    a = tools.align_audiovisual(s, "t", "times", "heard", "seen")
    return a.select("user_id", F.size("frames").cast("long").alias("n_frames"), F.size("transcripts").cast("long").alias("n_transcripts"))


@query("assess_state", f"""WITH {_ITEMS}, s AS (SELECT user_id, count(DISTINCT round_even(v, 1)) AS n, max(round_even(v, 1)) - min(round_even(v, 1)) AS span, user_id % 2 = 0 AS temporal FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN temporal AND least(n, 36) < 8 THEN CASE WHEN CASE WHEN n >= 2 THEN span ELSE 0 END < 1 THEN 'temporal_frames,temporal_span' ELSE 'temporal_frames' END WHEN temporal AND CASE WHEN n >= 2 THEN span ELSE 0 END < 1 THEN 'temporal_span' ELSE '' END AS missing FROM s""")
def assess(spark, sf):
    s = sessions(spark, sf).withColumns({"question": F.lit("What happens?"), "question_type": F.when(F.col("user_id") % 2 == 0, "counting").otherwise("general"), "profile": F.lit("balanced")})
    t = tools.retrieve_video(tools.state(s.withColumn("times", F.transform("new_frames", lambda f: f["timestamp"]))), "times", "new_scenes")
    return tools.assess(t).select("user_id", F.array_join("missing", ",").alias("missing"))


@query("observer_note_state", f"WITH {_ITEMS} SELECT user_id, least(12, count(*) + 1) AS n FROM e GROUP BY user_id")
def observer_note(spark, sf):
    """The last twelve notes of every session, cut by a group limit before they become an array, and one more."""
    last = packed(per_group(items(spark, sf), "user_id", 12, F.col("i").desc()).withColumn("tool", F.lit("x")).withColumn("timestamps", F.array("t_start")).withColumn("observation", F.col("text")), "user_id", "notes", ["i"], "tool", "observation", "timestamps")
    return last.select("user_id", F.size(ev.append_note(F.col("notes"), F.lit("focus"), F.lit("new"), F.array(F.lit(1.0)))).cast("long").alias("n"))


@query("subject_deltas", "SELECT conv_id, turn, trim(text) AS text, CASE turn % 3 WHEN 0 THEN 'p' || conv_id WHEN 1 THEN 'q' || conv_id END AS id FROM conversations")
def subject_deltas(spark, sf):
    t, c = F.col("turn"), F.col("conv_id").cast("string")
    line = F.when(t % 3 == 0, F.concat(F.lit('\nSUBJECT_DELTAS: {"deltas": [{"op": "add", "id": "p'), c, F.lit('"}]}'))).when(
        t % 3 == 1, F.concat(F.lit('\nSUBJECT_DELTAS: {"deltas":\n [{"op": "add", "id": "q'), c, F.lit('"}]}'))
    ).otherwise("\nSUBJECT_DELTAS: {none")
    d = read(spark, sf, "conversations").select("conv_id", "turn", parsing.subject_deltas(F.concat("text", line)).alias("d"))
    return d.select("conv_id", "turn", "d.text", F.try_element_at("d.deltas", F.lit(1))["id"].alias("id"))


@query("judge_replies", """SELECT conv_id, turn, turn % 4 IN (0, 1) AND conv_id % 2 = 0 AS correct, CASE WHEN turn % 4 < 3 THEN (turn % 6)::DOUBLE END AS score, turn % 4 = 3 AS broken FROM conversations""")
def judge_replies(spark, sf):
    from ..plans.evaluation import judge_json

    t = F.col("turn")
    yes = F.when((t % 4 < 2) & (F.col("conv_id") % 2 == 0), "true").otherwise("false")
    body = F.concat(F.lit('{"correct": '), yes, F.lit(', "score": '), (t % 6).cast("string"), F.lit(', "justification": "so"}'))
    reply = F.when(t % 4 == 0, body).when(t % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(t % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise("no idea")
    j = read(spark, sf, "conversations").select("conv_id", "turn", judge_json(reply).alias("j"))
    return j.select("conv_id", "turn", "j.correct", "j.score", F.col("j.error").isNotNull().alias("broken"))


@query("float_lists", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value::DOUBLE + event_id END AS total FROM events")
def float_lists(spark, sf):
    i, v = F.col("event_id"), F.col("value").cast("double").cast("string")
    both = F.concat(v, F.lit(", "), i.cast("string"))
    given = F.when(i % 4 == 0, both).when(i % 4 == 1, F.concat(F.lit("["), both, F.lit("]"))).when(i % 4 == 2, F.concat(F.lit(" "), both, F.lit(", "))).otherwise(F.concat(both, F.lit(", x")))
    e = read(spark, sf, "events").select("event_id", parsing.float_list(given).alias("xs"))
    return e.select("event_id", F.when(F.col("xs").isNotNull(), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("message_parts", "SELECT conv_id, turn, text FROM conversations")
def message_parts(spark, sf):
    """Messages as plain text or as a list of parts give the same text."""
    c, t = read(spark, sf, "conversations"), F.col("turn")
    half = (F.length("text") / 2).cast("int")
    a, b = F.substring("text", F.lit(1), half), F.expr("substring(text, cast(length(text) / 2 as int) + 1)")
    listed = F.concat(F.lit("["), F.to_json(F.struct(a.alias("text"))), F.lit(", "), F.to_json(F.struct(F.lit("text").alias("type"), b.alias("text"))), F.lit("]"))
    return c.select("conv_id", "turn", parsing.message_text(F.when(t % 2 == 0, F.col("text")).otherwise(listed)).alias("text"))


@query("option_keywords", r"""WITH t AS (SELECT item_id, rtrim(trim(text), '.') AS t FROM benchmark), w AS (SELECT item_id, t, list_filter(regexp_extract_all(t, '[A-Za-z一-鿿][A-Za-z0-9一-鿿''-]*'), lambda w: length(w) >= 2 AND NOT list_contains(%s, lower(w))) AS w FROM t)
SELECT item_id, CASE WHEN len(w) > 0 THEN list_slice(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), 1, 3) ELSE [t] END AS keywords FROM w""" % (list(parsing.OPTION_STOPWORDS),))
def option_keywords(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", parsing.option_keywords(F.concat(F.lit("A. "), "text")).alias("keywords"))


@query("benchmark_cases", """WITH k AS (SELECT item_id, text, ['Object Recognition', 'OCR Problems', 'Temporal Reasoning', 'Information Synopsis', 'other'][item_id % 5 + 1] AS task, item_id % 3 AS a FROM benchmark)
SELECT 'vme-' || item_id AS case_id, 'What?' || chr(10) || chr(10) || 'Candidates:' || chr(10) || 'A) no' || chr(10) || 'B) ' || trim(text) AS question, CASE task WHEN 'Object Recognition' THEN 'visual' WHEN 'OCR Problems' THEN 'visual' WHEN 'Information Synopsis' THEN 'overview' ELSE 'joint' END AS modality_tag,
 CASE task WHEN 'Object Recognition' THEN 'frame_or_slide' WHEN 'OCR Problems' THEN 'slide' WHEN 'Information Synopsis' THEN 'transcript' ELSE 'transcript,frame_or_slide' END AS kinds, CASE a WHEN 0 THEN 'no' ELSE trim(text) END AS reference_answer FROM k WHERE a < 2""")
def benchmark_cases(spark, sf):
    from ..datasets import benchmark_cases as convert

    i = F.col("item_id")
    tasks = F.array(*map(F.lit, ("Object Recognition", "OCR Problems", "Temporal Reasoning", "Information Synopsis", "other")))
    rows = read(spark, sf, "benchmark").select(
        i.cast("string").alias("question_id"), i.cast("string").alias("videoID"), F.lit("What?").alias("question"), F.array(F.lit("A. no"), F.concat(F.lit("B. "), "text")).alias("options"),
        F.element_at(F.array(F.lit(" a"), F.lit("B"), F.lit("E")), (i % 3 + 1).cast("int")).alias("answer"), F.element_at(tasks, (i % 5 + 1).cast("int")).alias("task_type"),
    )
    made = convert(rows, rows.select(F.col("videoID").alias("video"), F.concat(F.lit("v"), "videoID").alias("video_id")))
    return made.select("case_id", "question", "modality_tag", F.array_join("expected_citation_kinds", ",").alias("kinds"), "reference_answer")


@query("replayed_calls", """WITH c AS (SELECT user_id, event_id, event_id // 10 AS response, event_type || '::' || floor(value / 20)::INT AS sig, CASE WHEN event_id % 4 > 0 THEN 'r' || event_id END AS result FROM events),
k AS (SELECT c.*, (SELECT arg_min(p.result, p.response * 1000000 + p.event_id) FROM c p WHERE p.user_id = c.user_id AND p.sig = c.sig AND p.response < c.response AND p.result IS NOT NULL) AS known, row_number() OVER (PARTITION BY user_id, sig, response ORDER BY event_id) > 1 AS twin FROM c)
SELECT event_id, known IS NULL AND NOT twin AS run, coalesce(known, CASE WHEN twin THEN '' END) AS replayed FROM k""")
def replayed(spark, sf):
    i = F.col("event_id")
    e = read(spark, sf, "events").select("user_id", "event_id", F.floor(i / 10).alias("response"), F.concat_ws("::", "event_type", F.floor(F.col("value") / 20).cast("string")).alias("sig"), F.when(i % 4 > 0, F.concat(F.lit("r"), i.cast("string"))).alias("result"))
    return dl.replay(e, "user_id", "response", "event_id", "sig", "result").select("event_id", "run", "replayed")


@query("call_signatures", "SELECT event_id, event_type || '::' || '{\"a\":\"' || event_id || '\",\"b\":\"x\"}' AS signature FROM events")
def signatures(spark, sf):
    i = F.col("event_id").cast("string")
    args = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b": "x", "a": "'), i, F.lit('"}'))).otherwise(F.concat(F.lit('{"a":"'), i, F.lit('","b":"x"}')))
    return read(spark, sf, "events").select("event_id", dl.signature(F.col("event_type"), args).alias("signature"))


@query("last_turns", "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS asked, arg_max(text, turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id")
def last_turns(spark, sf):
    c = read(spark, sf, "conversations")
    ids = c.select("conv_id").distinct()
    last = lambda who, name: dl.last_of(c, "conv_id", "turn", who).withColumnRenamed("text", name)
    return ids.join(last("user", "asked"), "conv_id", "left").join(last("assistant", "said"), "conv_id", "left")


@query("call_results", "SELECT a.conv_id, a.turn, b.text AS result FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def call_results(spark, sf):
    c = read(spark, sf, "conversations")
    call = lambda t: F.concat_ws(":", "conv_id", t)
    calls = c.where("role = 'user'").select("conv_id", "turn", call(F.col("turn")).alias("call_id"))
    return dl.call_results(calls, c.where("role = 'assistant'").select(call(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))).select("conv_id", "turn", "result")


@query("heal_dangling", """WITH l AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS lc FROM conversations), b AS (SELECT conv_id, any_value(lc) AS lc FROM l GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant' AND turn = lc + 1) = 0 AND any_value(lc) IS NOT NULL)
SELECT c.conv_id, turn FROM conversations c LEFT JOIN b USING (conv_id) WHERE lc IS NULL OR turn < lc""")
def heal(spark, sf):
    c = read(spark, sf, "conversations")
    call = lambda t: F.concat_ws(":", "conv_id", t)
    log = c.withColumn("calls", F.when(F.col("role") == "user", F.array(call(F.col("turn"))))).withColumn("call_id", F.when(F.col("role") == "assistant", call(F.col("turn") - 1)))
    return dl.heal(log, "conv_id", "turn").select("conv_id", "turn")


@query("guard_payloads", """SELECT event_id, CASE WHEN event_id % 10 >= 8 THEN 'cap' WHEN event_id % 13 = 0 THEN 'stalled' WHEN event_id % 5 = 0 THEN 'final' WHEN event_id % 5 = 1 THEN 'verify' WHEN event_id % 5 = 2 THEN 'reanswer' WHEN event_id % 5 = 3 AND event_id % 2 = 0 THEN 'answer' ELSE 'plan' END AS step FROM events""")
def guard_payloads(spark, sf):
    from ..plans.planner import guard

    i = F.col("event_id")
    payloads = (
        '{"tool": "verify_grounding", "grounding_report": {"grounded": true}, "answer": "so"}', '{"tool": "answer_with_evidence", "answer": "so", "next": "verify_grounding"}',
        '{"tool": "verify_grounding", "grounding_report": {"grounded": false}, "next": "answer_with_evidence"}', '{"tool": "assess_evidence_sufficiency", "sufficient": true}', "no json",
    )
    payload = F.element_at(F.array(*map(F.lit, payloads)), (i % 5 + 1).cast("int"))
    facts = dl.guard_inputs(payload, (i % 10).cast("int"), i % 13 == 0, i % 2 == 0, F.lit(False))
    return read(spark, sf, "events").select("event_id", *[v.alias(k) for k, v in facts.items()]).select("event_id", guard().alias("step"))


@query("chat_fold", """WITH k AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id::VARCHAR AS session, count(*) FILTER (turn > 0) AS tokens, sum(length(text)) FILTER (turn > 0) AS chars FROM k GROUP BY conv_id""")
def chat_fold(spark, sf):
    """Every conversation's turns as planner words; a tool runs after the first, so only later ones are sent."""
    c = read(spark, sf, "conversations").withColumn("conv_id", F.col("conv_id").cast("string"))
    word = c.select(F.col("conv_id").alias("session"), (F.col("turn") * 2).alias("pos"), F.lit("token").alias("kind"), F.to_json(F.struct("text")).alias("data"))
    tool = c.where("turn = 0").select(F.col("conv_id").alias("session"), F.lit(1).alias("pos"), F.lit("tool").alias("kind"), F.lit('{"updates": []}').alias("data"))
    sent = chat.fold_events(word.unionByName(tool))
    return sent.groupBy("session").agg(F.count_if(F.col("event") == "token").alias("tokens"), F.sum(F.when(F.col("event") == "token", F.length(F.get_json_object("data", "$.text")))).alias("chars"))


@query("memory_search", "SELECT event_id FROM (SELECT event_id, CASE WHEN contains(event_type, 'view') THEN 1 ELSE 0 END AS s FROM events WHERE user_id = (SELECT min(user_id) FROM events)) ORDER BY s DESC, event_id DESC LIMIT 6")
def memory_search(spark, sf):
    e = read(spark, sf, "events")
    mine = e.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id")
    notes = mine.select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("note"), F.col("event_id").alias("at"))
    return chat.memories(notes, None, "View").select(F.col("at").alias("event_id"))


@query("checkpoint_store", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (value > 50) AS value FROM events GROUP BY user_id")
def checkpoint_store(spark, sf):
    e = read(spark, sf, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return chat.checkpoints(e, "user_id", "event_id", "event_type", "value")


@query("resolve_files", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '/v/' || p_partkey % 3 || '/clip' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.mp4' ELSE '.webm' END END AS path FROM part")
def resolve_files(spark, sf):
    from ..sources.files import resolve_files as resolve

    k = F.col("p_partkey")
    parts = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("clip"), k.cast("string"), F.lit(".mp4")).alias("name"))
    files = parts.where(k % 3 < 2).select(F.concat(F.lit("/v/"), (k % 3).cast("string"), F.lit("/clip"), k.cast("string"), F.when(k % 3 == 0, ".mp4").otherwise(".webm")).alias("path"))
    return resolve(parts, files).select("p_partkey", "path")


@query("stage_copies", "WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_partkey // 2 END AS c FROM part) SELECT p_partkey, CASE WHEN c IS NULL THEN 'missing' WHEN c % 5 = 0 OR row_number() OVER (PARTITION BY c ORDER BY p_partkey) > 1 THEN 'skipped' ELSE 'staged' END AS status FROM f")
def stage_copies(spark, sf):
    from ..sources.files import stage_copies as stage

    k = F.col("p_partkey")
    parts = read(spark, sf, "part").select(k.alias("name"))
    files = parts.where("name % 4 > 0").select("name", F.floor(F.col("name") / 2).alias("content_id"))
    done = files.where("content_id % 5 = 0").select("content_id")
    return stage(parts, files, done).select(F.col("name").alias("p_partkey"), "status")


@query("split_audit", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'not_in_manifest' ELSE 'file_missing' END AS reason FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def split_audit(spark, sf):
    from ..sources.files import split_audit as split

    c = read(spark, sf, "part").select(F.col("p_partkey").alias("case_id"))
    manifest = c.where("case_id % 3 > 0").select("case_id", F.col("case_id").alias("video"))
    files = c.where("case_id % 5 > 0").select(F.col("case_id").alias("video"), F.lit("p").alias("path"))
    return split(c, manifest, files)[1].select(F.col("case_id").alias("p_partkey"), "reason")


@query("frequent_videos", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 4 ORDER BY n DESC, source LIMIT 4")
def frequent(spark, sf):
    from ..datasets import frequent_videos

    return frequent_videos(read(spark, sf, "documents"), "source", 4, 4)


@query("new_cases", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def new_cases(spark, sf):
    from ..datasets import new_cases as fresh

    return fresh(read(spark, sf, "labels").select("doc_id"), read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query("frame_names", "SELECT event_id, 't' || lpad(printf('%.1f', round(value::DOUBLE, 1)), 6, '0') || '.jpg' AS name, least(249, greatest(0, round_even(value::DOUBLE * 2.5, 0)::INT)) AS idx FROM events")
def frame_names(spark, sf):
    v = F.round(F.col("value").cast("double"), 1)
    return read(spark, sf, "events").select("event_id", parsing.frame_name(v).alias("name"), parsing.time_index(F.col("value").cast("double"), F.lit(2.5), F.lit(250)).alias("idx"))


@query("difference_hash")
def difference_hash(spark, sf):
    from ..udf import picture_hashes

    return picture_hashes(read(spark, sf, "documents").select("doc_id", F.md5("text").alias("name")), "name", "hash").select("doc_id", "hash")


@query("transcribe_stub")
def transcribe(spark, sf):
    from ..udf import transcribe as run

    return run(read(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("path")), "path").select("p_partkey", "t_start", "t_end", "text")


@query("probe_stub")
def probe(spark, sf):
    from ..udf import probe as run

    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select("p_partkey", F.concat(k.cast("string"), F.when(k % 5 == 0, ".broken").otherwise(".mp4")).alias("path"))
    return run(rows, "path", repair=lambda p: p.replace(".broken", ".mp4") if int(p.split(".")[0]) % 2 else p, duration=lambda p: 1.0).select("p_partkey", "duration", "error")


@query("chat_stream_fold", ORACLES["chat_fold"])
def chat_stream_fold(spark, sf):
    """``chat_fold`` as a stream: the same events in four cuts that heed neither sessions nor order."""
    c = read(spark, sf, "conversations").withColumn("session", F.col("conv_id").cast("string"))
    word = c.select("session", F.when(F.col("turn") == 0, 0).otherwise(F.col("turn") + 1).alias("pos"), F.lit("token").alias("kind"), F.to_json(F.struct("text")).alias("data"))
    tool = c.where("turn = 0").select("session", F.lit(1).alias("pos"), F.lit("tool").alias("kind"), F.lit('{"updates": []}').alias("data"))
    events, path = word.unionByName(tool), scratch(spark, "chat")
    for k in range(4):
        events.where(F.pmod(F.xxhash64("session", "pos"), F.lit(4)) == k).coalesce(2).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    sent = sessions_of.run_to_table(sessions_of.fold_stream(stream), scratch(spark, "sent"), scratch(spark, "chat-state"))
    return sent.groupBy("session").agg(F.count_if(F.col("event") == "token").alias("tokens"), F.sum(F.when(F.col("event") == "token", F.length(F.get_json_object("data", "$.text")))).alias("chars"))


@query(
    "progress_stream",
    """WITH p AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE event_type END AS stage FROM events WHERE event_id % 10 <> 0),
s AS (SELECT user_id, event_id AS subscriber, ts AS since FROM events WHERE event_id % 10 = 0),
l AS (SELECT user_id, subscriber, since, max(p.ts) AS last FROM s LEFT JOIN p USING (user_id) WHERE p.ts <= since OR p.ts IS NULL GROUP BY ALL),
r AS (SELECT s.*, p.stage, p.event_id FROM s LEFT JOIN l USING (user_id, subscriber, since) LEFT JOIN p ON p.user_id = s.user_id AND p.ts = last),
e AS (SELECT subscriber, min(p.ts) AS stop FROM s JOIN p USING (user_id) WHERE p.ts > since AND stage IN ('done', 'failed') GROUP BY subscriber),
o AS (SELECT subscriber, event_id, stage FROM r WHERE stage IS NOT NULL
 UNION ALL SELECT subscriber, p.event_id, p.stage FROM r JOIN p USING (user_id) LEFT JOIN e USING (subscriber) WHERE p.ts > since AND coalesce(r.stage NOT IN ('done', 'failed'), true) AND (stop IS NULL OR p.ts <= stop))
SELECT subscriber::VARCHAR AS subscriber, event_id::VARCHAR AS item, stage, CASE stage WHEN 'done' THEN 'done' WHEN 'failed' THEN 'error' ELSE 'stage' END AS event FROM o""",
)
def progress_stream(spark, sf):
    """Events of a user as progress of a video; every tenth is a subscriber. Four cuts by time, then one row that ends the wait."""
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stage = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    rows = e.select(F.col("user_id").cast("string").alias("video"), "ts", stage.alias("stage"), F.col("event_id").cast("string").alias("item"), (F.col("event_id") % 10 == 0).alias("subscribes"))
    path = scratch(spark, "progress")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for k in range(4):
        rows.where(week == k).coalesce(1).write.mode("append").parquet(path)
    end = rows.limit(1).select(F.lit("").alias("video"), F.expr("timestamp'2200-01-01'").alias("ts"), F.lit("end").alias("stage"), F.lit("").alias("item"), F.lit(False).alias("subscribes"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    feed = sessions_of.feed_stream(stream.where("not subscribes"), stream.where("subscribes").withColumnRenamed("item", "subscriber"), "1 day", 86_400)
    return sessions_of.run_to_table(feed, scratch(spark, "feed"), scratch(spark, "feed-state")).select("subscriber", "item", "stage", "event")


@query(
    "checkpoint_history",
    """SELECT user_id AS thread, event_id AS step, last_value(event_type IGNORE NULLS) OVER w AS event_type, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER w AS value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def checkpoint_history(spark, sf):
    """Updates of all sessions put into a store in two goes; the state after every step."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("step"), "event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    store = sessions_of.CheckpointStore(spark, scratch(spark, "checkpoints"), "event_type", "value")
    store.put(e.where("step % 2 = 1"))
    store.put(e.where("step % 2 = 0"))
    return store.history()
