"""Message logs, agent loops and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogue as dl
from ..operators import merge
from ..streaming import state
from .registry import query, read
from .temporal import EPOCH, T_SQL, seconds


@query("stalled_verify", "WITH r AS (SELECT conv_id, text, lead(text) OVER w AS b, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, coalesce(text = b AND trim(text) <> '', false) AS stalled FROM r WHERE rn = 1")
def stalled(spark, sf):
    return dl.stalled(read(spark, sf, "conversations"), "conv_id", "turn")


_LAST = "h AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS lh FROM conversations)"


@query("since_last_user", f"WITH {_LAST} SELECT conv_id, count(*) AS turns FROM h WHERE lh IS NULL OR turn > lh GROUP BY conv_id")
def since_last(spark, sf):
    return dl.since_last_human(read(spark, sf, "conversations"), "conv_id", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("visible_history", f"WITH {_LAST} SELECT conv_id, turn, role FROM h WHERE CASE WHEN turn <= coalesce(lh, -1) THEN role = 'user' OR (role = 'assistant' AND trim(text) <> '') ELSE role <> 'system' END")
def visible(spark, sf):
    return dl.visible(read(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("recent_history", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r BETWEEN 2 AND 5 AND role IN ('user', 'assistant')")
def recent(spark, sf):
    return dl.history(read(spark, sf, "conversations"), "conv_id", "turn", 5).select("conv_id", "turn")


@query("observer_notes", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def notes(spark, sf):
    return dl.last_notes(read(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query("longest_valid_draft", "SELECT conv_id, arg_max(turn, length(text) * 1000 - turn) AS turn, max(length(text)) AS n FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def longest(spark, sf):
    c = read(spark, sf, "conversations").where("role = 'assistant'")
    d = dl.longest_draft(c, "conv_id", "turn")
    return d.join(c, (d.conv_id == c.conv_id) & (d.draft == c.text)).groupBy(d.conv_id).agg(F.min("turn").alias("turn"), F.max(F.length("draft")).cast("long").alias("n"))


@query("dangling_calls", "SELECT conv_id, turn FROM conversations a WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant')")
def dangling(spark, sf):
    c = read(spark, sf, "conversations")
    call = lambda t: F.concat_ws(":", "conv_id", t)
    calls = c.where("role = 'user'").select("conv_id", "turn", call(F.col("turn")).alias("call"))
    return dl.dangling(calls, c.where("role = 'assistant'").select(call(F.col("turn") - 1).alias("call")), "call").select("conv_id", "turn")


@query("dedup_tool_calls", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY event_id) = 1 AS first FROM events")
def dedup_calls(spark, sf):
    return dl.dedup_calls(read(spark, sf, "events"), "user_id", ["event_type", F.floor("value")], "event_id").select("event_id", "first")


@query("agent_loop_eval", "WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS actions FROM events GROUP BY user_id) SELECT user_id, len(actions) AS n, coalesce(list_position(actions, 'purchase') > 0 AND list_contains(list_slice(actions, list_position(actions, 'purchase'), len(actions)), 'view'), false) AS post_answer_retrieval, list_contains(actions, 'purchase') AS expected FROM a")
def agent_loop(spark, sf):
    a = dl.action_sequence(read(spark, sf, "events"), "user_id", "event_id", "event_type")
    late = dl.post_answer_retrieval(F.col("actions"), "purchase", ["view"])
    return a.select("user_id", F.size("actions").cast("long").alias("n"), late.alias("post_answer_retrieval"), F.array_contains("actions", "purchase").alias("expected"))


@query("last_write_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN value > 50 THEN value END, CASE WHEN value > 50 THEN event_id END) AS last_large FROM events GROUP BY user_id")
def last_write(spark, sf):
    e = read(spark, sf, "events").withColumn("last_large", F.when(F.col("value") > 50, F.col("value")))
    return merge.last_write(e, "user_id", "event_id", "event_type", "last_large")


@query("union_merge_state", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS event_type FROM events GROUP BY user_id")
def union_merge(spark, sf):
    return merge.union_merge(read(spark, sf, "events"), "user_id", "event_type")


@query("progress_latest", f"SELECT user_id, arg_max(event_type, ts) AS stage, max({T_SQL}) AS at FROM events GROUP BY user_id")
def progress_latest(spark, sf):
    p = state.latest_progress(seconds(read(spark, sf, "events")).withColumnRenamed("event_type", "stage"), "user_id", "t", "stage")
    return p.select("user_id", "stage", F.col("t").alias("at"))


@query("event_windows", "SELECT epoch(date_trunc('day', ts)) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = state.windowed_counts(e, "ts", "event_type")
    return w.select((F.unix_micros("start") / 1e6).alias("start_s"), "event_type", "n")


@query("registry_fold", f"""WITH e AS (SELECT user_id, event_id, event_type, event_id % 3 = 0 AS added, {T_SQL} AS t, floor(value)::BIGINT::VARCHAR AS v FROM events),
s AS (SELECT user_id, event_type, min(event_id) AS start FROM e WHERE added GROUP BY ALL),
l AS (SELECT user_id, event_type, start, max(t) AS last_seen_t, min(t) FILTER (added) AS first_seen_t, list(v ORDER BY event_id) AS vs FROM e JOIN s USING (user_id, event_type) WHERE event_id >= start GROUP BY ALL)
SELECT user_id AS thread, event_type AS id, round(first_seen_t, 3) AS first_seen_t, round(last_seen_t, 3) AS last_seen_t, list_sort(list_distinct(vs)) AS attributes FROM l
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN last_seen_t IS NULL THEN 0 ELSE last_seen_t END DESC, start) <= 15""")
def registry(spark, sf):
    e = read(spark, sf, "events")
    op = F.when(F.col("event_id") % 3 == 0, "add").otherwise("update")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH
    value = F.array(F.floor("value").cast("string"))
    delta = F.to_json(F.struct(op.alias("op"), F.col("event_type").alias("id"), t.alias("first_seen_t"), t.alias("last_seen_t"), value.alias("attributes"), value.alias("attributes_add"), F.array(t).alias("evidence_frames")))
    found = state.registries(e.select(F.col("user_id").alias("thread"), F.col("event_id").alias("pos"), delta.alias("delta")))
    return found.select("thread", "id", F.round("first_seen_t", 3).alias("first_seen_t"), F.round("last_seen_t", 3).alias("last_seen_t"), F.array_sort(F.array_distinct("attributes")).alias("attributes"))


@query("registry_sets", "SELECT user_id, event_type, max(event_id) AS last_seen, list_sort(list(DISTINCT floor(value)::BIGINT)) AS attributes FROM events GROUP BY user_id, event_type")
def registry_sets(spark, sf):
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_seen"), F.array_sort(F.collect_set(F.floor("value"))).alias("attributes"))


@query("agent_guards", """SELECT calls, stalled, grounded, unverified, CASE WHEN calls >= 8 THEN 'cap' WHEN stalled THEN 'stalled' WHEN grounded THEN 'final' WHEN unverified THEN 'verify' WHEN reanswer THEN 'reanswer' WHEN answerable THEN 'answer' ELSE 'plan' END AS step, event_id
FROM (SELECT event_id, (event_id % 10)::INT AS calls, event_id % 7 = 0 AS stalled, event_id % 5 = 0 AS grounded, event_id % 3 = 0 AS unverified, event_id % 4 = 1 AS reanswer, event_id % 2 = 0 AS answerable FROM events)""")
def guards(spark, sf):
    from ..plans.planner import guard

    i = F.col("event_id")
    e = read(spark, sf, "events").select("event_id", (i % 10).cast("int").alias("calls"), (i % 7 == 0).alias("stalled"), (i % 5 == 0).alias("grounded"), (i % 3 == 0).alias("unverified"), (i % 4 == 1).alias("reanswer"), (i % 2 == 0).alias("answerable"))
    return e.select("event_id", "calls", "stalled", "grounded", "unverified", guard().alias("step"))
