"""Message logs: one row per turn, ordered within a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def since_last_human(log: DataFrame, key: str, pos: str, role: str = "role", human: str = "user") -> DataFrame:
    """Turns after the last human one (all turns where there's none), that turn left out."""
    last = F.max(F.when(F.col(role) == human, F.col(pos))).over(W.partitionBy(key))
    return log.withColumn("_h", last).where(F.col("_h").isNull() | (F.col(pos) > F.col("_h"))).drop("_h")


def visible(log: DataFrame, key: str, pos: str, role: str = "role", text: str = "text") -> DataFrame:
    """Up to the last human turn: human turns and non-empty answers; after it: everything but system turns."""
    last = F.max(F.when(F.col(role) == "user", F.col(pos))).over(W.partitionBy(key))
    keep = F.when(F.col(pos) <= F.coalesce(last, F.lit(-1)), (F.col(role) == "user") | ((F.col(role) == "assistant") & (F.trim(text) != ""))).otherwise(F.col(role) != "system")
    return log.withColumn("_k", keep).where("_k").drop("_k")


def history(log: DataFrame, key: str, pos: str, n: int = 10, role: str = "role") -> DataFrame:
    """The last ``n`` turns but the very last, human and assistant only."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.col(pos).desc()))
    return log.withColumn("_r", r).where((F.col("_r") >= 2) & (F.col("_r") <= n) & F.col(role).isin("user", "assistant")).drop("_r")


def stalled(log: DataFrame, key: str, pos: str, text: str = "text") -> DataFrame:
    """``(key, stalled)``: the last two answers are equal and not blank."""
    w = W.partitionBy(key).orderBy(F.col(pos).desc())
    rows = log.withColumn("_r", F.row_number().over(w)).withColumn("_b", F.lead(text).over(w)).where("_r = 1")
    return rows.select(key, F.coalesce((F.col(text) == F.col("_b")) & (F.trim(text) != ""), F.lit(False)).alias("stalled"))


def longest_draft(log: DataFrame, key: str, pos: str, text: str = "text") -> DataFrame:
    """The longest text of each conversation that isn't blank or cut in a character; the first on ties."""
    ok = log.where((F.trim(text) != "") & ~F.endswith(F.col(text), F.lit("�")))
    return ok.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), (-F.col(pos)).alias("p"))).alias("draft"))


def dedup_calls(calls: DataFrame, thread: str, signature: list, order: str) -> DataFrame:
    """Each call with ``first`` (run it) or not (its result is known from the first)."""
    return calls.withColumn("first", F.row_number().over(W.partitionBy(thread, *signature).orderBy(order)) == 1)


def dangling(calls: DataFrame, results: DataFrame, call_id: str) -> DataFrame:
    return calls.join(results, call_id, "left_anti")


def action_sequence(log: DataFrame, key: str, pos: str, action: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos, action))), lambda x: x[action])
    return log.groupBy(key).agg(ordered.alias("actions"))


def post_answer_retrieval(actions, answer: str, retrieval: list[str]):
    """Whether a retrieval action follows the first answer action."""
    at = F.array_position(actions, answer)
    rest = F.slice(actions, F.greatest(at, F.lit(1)).cast("int"), F.size(actions))
    return F.when(at > 0, F.arrays_overlap(rest, F.array(*[F.lit(r) for r in retrieval]))).otherwise(F.lit(False))


def last_notes(log: DataFrame, key: str, pos: str, n: int = 12, text: str = "text") -> DataFrame:
    r = F.row_number().over(W.partitionBy(key).orderBy(F.col(pos).desc()))
    return log.where(F.trim(text) != "").withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def signature(name, args) -> F.Column:
    """A call's name and its arguments in key order; what isn't a JSON object counts as it is."""
    parsed = F.from_json(args, "map<string,string>")
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parsed))))
    return F.concat(F.coalesce(name, F.lit("")), F.lit("::"), F.coalesce(F.when(F.trim(args).startswith("{"), ordered), args, F.lit("{}")))


def call_results(calls: DataFrame, results: DataFrame, call_id: str = "call_id") -> DataFrame:
    """Calls with their results, by call id."""
    return calls.join(results, call_id)


def replay(calls: DataFrame, thread: str, response: str, pos: str, sig: str, result: str) -> DataFrame:
    """Adds ``run`` and ``replayed``: a call seen in an earlier response gets that call's first result, one repeated within its response an empty one.

    ``response`` numbers a thread's responses; ``result`` is null where a call has none.
    """
    before = W.partitionBy(thread, sig).orderBy(response).rangeBetween(W.unboundedPreceding, -1)
    known = F.min(F.when(F.col(result).isNotNull(), F.struct(response, pos, result))).over(before)[result]
    twin = F.row_number().over(W.partitionBy(thread, sig, response).orderBy(pos)) > 1
    made = calls.withColumn("_k", known).withColumn("_t", twin)
    return made.withColumn("run", F.col("_k").isNull() & ~F.col("_t")).withColumn("replayed", F.coalesce("_k", F.when(F.col("_t"), F.lit("")))).drop("_k", "_t")


def last_of(log: DataFrame, key: str, pos: str, who: str, role: str = "role", text: str = "text") -> DataFrame:
    """``(key, text)`` of the last turn of a role."""
    return log.where(F.col(role) == who).groupBy(key).agg(F.max_by(text, pos).alias(text))


def heal(log: DataFrame, key: str, pos: str, calls: str = "calls", call_id: str = "call_id") -> DataFrame:
    """The log without its tail from the last turn with calls on, where some of its calls have no result.

    ``calls`` is the array of ids that a turn calls, ``call_id`` the call that a tool turn answers.
    """
    has = F.size(F.coalesce(calls, F.array().cast("array<string>"))) > 0
    last = log.where(has).groupBy(key).agg(F.max(pos).alias("_p"), F.max_by(calls, pos).alias("_c"))
    done = log.join(last, key).where(F.col(pos) > F.col("_p")).groupBy(key).agg(F.collect_set(call_id).alias("_d"))
    broken = last.join(done, key, "left").where(F.size(F.array_except("_c", F.coalesce("_d", F.array().cast("array<string>")))) > 0).select(key, "_p")
    return log.join(broken, key, "left").where(F.col("_p").isNull() | (F.col(pos) < F.col("_p"))).drop("_p")


def guard_inputs(payload, calls, stalled_flag, has_evidence, answered) -> dict[str, F.Column]:
    """The columns of ``planner.guard`` from the last tool payload (JSON) and facts of the thread."""
    get = lambda path: F.get_json_object(payload, path)
    tool, then = F.coalesce(get("$.tool"), F.lit("")), F.coalesce(get("$.next"), F.lit(""))
    grounded = F.coalesce(get("$.grounding_report.grounded") == "true", F.lit(False))
    verify, enough = tool == "verify_grounding", F.coalesce(get("$.sufficient") == "true", F.lit(False)) | (get("$.recommended_next_action") == "answer_with_evidence")
    return {
        "calls": calls, "stalled": stalled_flag, "grounded": verify & grounded & (F.trim(F.coalesce(get("$.answer"), F.lit(""))) != ""),
        "unverified": (tool == "answer_with_evidence") & (F.coalesce(get("$.error"), F.lit("")) == "") & (then == "verify_grounding"),
        "reanswer": verify & ~grounded & then.isin("revise_answer_with_citations", "answer_with_evidence"),
        "answerable": has_evidence & ~answered & (tool == "assess_evidence_sufficiency") & F.coalesce(enough, F.lit(False)),
    }


def answer_mode(kind, profile) -> F.Column:
    """How cautiously to answer."""
    return F.when(profile == "negative_check", "negative_cautious").when(kind.isin("temporal_order", "counting", "comparison"), "temporal").otherwise("direct")
