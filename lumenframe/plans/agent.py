"""The agent as an iterative dataflow: many sessions, one step a round.

A round decides every open session's step (runtime guards first, then the planner), ends those that are through,
deals the others to their tools by name and writes the new state. So a round is one job over the open
sessions, a lost executor repeats one round at most, and what the driver learns is whether any session is open.
Every step but an end is a tool call, and after ``most`` calls the cap allows one forced answer, so there
are at most ``most + 2`` rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from . import planner as pl

VERIFY, ANSWER, ASSESS = "verify_grounding", "answer_with_evidence", "assess_evidence_sufficiency"
FINAL = "final"
#: What the loop keeps of a session besides the columns it came with.
LOOP = {"calls": "int", "steps": "array<string>", "last": "string", "fails": "int", "forced": "boolean", "ended": "string"}
#: What tools say that guards and planners read; a tool renews the ones it makes.
SAID = {"answer": "string", "grounded": "boolean", "next_action": "string", "sufficient": "boolean", "recommended_next_action": "string", "missing": "array<string>", "confidence": "double"}
#: Failed verifications in a row after which a draft is taken as it is.
STALLED = 2

Tool = Callable[[DataFrame], DataFrame]


def begin(rows: DataFrame) -> DataFrame:
    """Open sessions that nothing has been done for."""
    made = {c: F.lit(None).cast(t) for c, t in SAID.items() if c not in rows.columns}
    first = {"calls": F.lit(0), "steps": F.array().cast("array<string>"), "last": F.lit(None).cast("string"), "fails": F.lit(0), "forced": F.lit(False), "ended": F.lit(None).cast("string")}
    return rows.withColumns(made | first)


def said_something(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def facts(most: int = pl.MAX_CALLS) -> dict[str, Column]:
    """The columns that ``planner.guard`` reads, from the state of a session."""
    last, answered = F.coalesce("last", F.lit("")), said_something(F.col("answer"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        # a guard's own cap is MAX_CALLS, whatever cap this loop has
        "calls": F.when(F.col("calls") >= most, F.lit(pl.MAX_CALLS)).otherwise(F.least(F.col("calls"), F.lit(pl.MAX_CALLS - 1))), "stalled": (F.col("fails") >= STALLED) & answered,
        "grounded": (last == VERIFY) & yes("grounded") & answered, "unverified": (last == ANSWER) & answered,
        "reanswer": (last == VERIFY) & ~yes("grounded") & (F.coalesce("next_action", F.lit("")) == ANSWER), "answerable": (last == ASSESS) & yes("sufficient"),
    }


def decide(rows: DataFrame, planner: Callable[[DataFrame], Column], has_evidence: Column, most: int = pl.MAX_CALLS) -> DataFrame:
    """Adds ``step``: a tool's name, or null where the session ends, and then why in ``ended``."""
    planned = rows.withColumn("_plan", planner(rows)).withColumn("_evidence", has_evidence)
    packed = planned.select(F.struct(*planned.columns).alias("_row"), *[v.alias(k) for k, v in facts(most).items()])
    chosen = packed.select("_row.*", pl.guard().alias("_guard"))
    answered, g = said_something(F.col("answer")), F.col("_guard")
    force = (g == "cap") & F.col("_evidence") & ~answered & ~F.col("forced")
    step = F.when(force | g.isin("reanswer", "answer"), ANSWER).when(g == "verify", VERIFY).when((g == "plan") & (F.col("_plan") != FINAL), F.col("_plan"))
    why = F.when(g == "cap", F.when(answered, "draft").otherwise("cap")).when(g == "stalled", "draft").when(g == "final", "grounded").otherwise(FINAL)
    chosen = chosen.withColumn("step", step).withColumn("forced", F.col("forced") | force)
    return chosen.withColumn("ended", F.when(F.col("step").isNull(), why)).drop("_plan", "_evidence", "_guard")


def apply(rows: DataFrame, tools: dict[str, Tool], columns: list[str]) -> DataFrame:
    """Every row through the tool that its ``step`` names."""
    out = rows.where(~F.col("step").isin(*tools)).withColumn("ended", F.lit("unknown_tool")).select(*columns)
    for name, tool in tools.items():
        mine = rows.where(F.col("step") == name)
        # what tools say is set aside, so that a tool may add it without a clash
        aside = mine.withColumn("_said", F.struct(*SAID)).withColumn("_loop", F.struct(*LOOP)).drop(*(c for c in SAID if c != "answer"), *LOOP, "step")
        made = tool(aside)
        kept = {c: F.col(c).cast(t) if c in made.columns else F.col(f"_said.{c}") for c, t in SAID.items()}
        called = {
            "calls": F.col("_loop.calls") + 1, "steps": F.concat("_loop.steps", F.array(F.lit(name))), "last": F.lit(name), "forced": F.col("_loop.forced"), "ended": F.col("_loop.ended"),
            "fails": F.when(F.coalesce(kept["grounded"], F.lit(False)), 0).otherwise(F.col("_loop.fails") + 1) if name == VERIFY else F.col("_loop.fails"),
        }
        rest = [c for c in columns if c not in SAID and c not in LOOP]
        out = out.unionByName(made.select(*rest, *[v.alias(c) for c, v in (kept | called).items()]))
    return out


def run(rows: DataFrame, planner: Callable[[DataFrame], Column], tools: dict[str, Tool], has_evidence: Column, most: int = pl.MAX_CALLS) -> DataFrame:
    """All sessions when they have ended: their columns, ``calls``, ``steps``, ``answer``, ``ended`` and what tools said last.

    ``planner`` gives a column of tool names, or ``final``; tools take and return session rows. ``has_evidence`` tells
    whether an answer may be forced at the cap.
    """
    state, done = begin(rows), None
    columns = state.columns
    for _ in range(most + 3):
        decided = stored(decide(state, planner, has_evidence, most), "agent")
        ended = decided.where("step is null").select(*columns)
        done = ended if done is None else done.unionByName(ended)
        going = decided.where("step is not null")
        if going.isEmpty():
            return done
        state = apply(going, tools, columns)
        if len(tools) > 0:
            lost = state.where("ended is not null")
            done, state = done.unionByName(lost), state.where("ended is null")
    raise AssertionError("a session goes on after its cap")


def rule_planner(rows: DataFrame) -> Column:
    """A planner without a model: search, assess, and then what the assessment or the verification asks for."""
    last = F.coalesce("last", F.lit(""))
    asked = F.coalesce(F.when(last == ASSESS, F.col("recommended_next_action")).when(last == VERIFY, F.col("next_action")), F.lit("retrieve_transcript_evidence"))
    return F.when(last.isin("", ANSWER), F.lit("retrieve_transcript_evidence")).when(last.isin(ASSESS, VERIFY), asked).otherwise(F.lit(ASSESS))
