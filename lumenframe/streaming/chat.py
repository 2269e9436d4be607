"""Chat streams: events folded into what a client is sent, session state, memories."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

EVIDENCE = ("frames", "scene_hits", "transcripts", "slides")
SENT = "session string, no int, event string, data string"


class Fold:
    """The state of one session's stream: planner words are held back until a tool has run or the plan ends without a call."""

    def __init__(self):
        self.tools, self.held, self.answer, self.final = False, [], "", ""

    def feed(self, kind: str, data: dict) -> list[tuple[str, dict]]:
        """What an event sends. Kinds: tool, token, plan_end, end, error."""
        out: list[tuple[str, dict]] = []
        if kind == "tool":
            self.tools, self.held = True, []
            found = {k: [x for u in data.get("updates") or [] for x in u.get(k) or []] for k in EVIDENCE}
            if any(found.values()):
                out.append(("frames", found))
        elif kind == "token" and data.get("node", "orchestrator") == "orchestrator" and data.get("text"):
            if self.tools:
                out.append(self.say(data["text"]))
            else:
                self.held.append(data["text"])
        elif kind == "plan_end" and not self.tools and self.held:
            if not data.get("tool_calls"):
                out += [self.say(t) for t in self.held]
            self.held = []
        elif kind == "end":
            if not self.answer and data.get("last_answer"):
                out.append(self.say(data["last_answer"]))
            out.append(("done", {}))
        elif kind == "error":
            out.append(("error", {"detail": data.get("detail", "")}))
        return out

    def say(self, text: str) -> tuple[str, dict]:
        self.answer += text
        return "token", {"text": text}


def fold_events(events: DataFrame) -> DataFrame:
    """``(session, no, event, data)`` that clients are sent, from ``(session, pos, kind, data json)``.

    Works on a stream too, where each micro-batch holds whole sessions. A session is one task's.
    """
    ship(events.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, rows = Fold(), []
        for kind, data in pdf.sort_values("pos")[["kind", "data"]].itertuples(index=False):
            rows += fold.feed(kind, json.loads(data) if data else {})
        return pd.DataFrame([(pdf["session"].iloc[0], i, e, json.dumps(d, ensure_ascii=False)) for i, (e, d) in enumerate(rows)], columns=["session", "no", "event", "data"])

    return events.groupBy("session").applyInPandas(run, SENT)


def sse(event: Column, data: Column) -> Column:
    """An event in the form that browsers read."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def write_sse(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of ``(event, data)`` as text, one folder a batch, so a batch that runs twice is written once."""

    def write(batch: DataFrame, no: int) -> None:
        batch.select(sse(F.col("event"), F.col("data")).alias("value")).write.mode("overwrite").text(f"{path}/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoints(log: DataFrame, thread: str, step: str, *values: str) -> DataFrame:
    """The latest stored value of each column of every thread, nulls passed over."""
    return log.groupBy(thread).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(step))).alias(v) for v in values])


def memories(notes: DataFrame, user: str | None, query: str | None, k: int = 6) -> DataFrame:
    """A user's notes ``(user, note, at)`` that share most words with the query, the latest first among equals; the latest without a query.

    Without ``user`` the notes are one user's already.
    """
    mine = notes if user is None else notes.where(F.col("user") == user)
    words = [w for w in (query or "").lower().split() if w]
    score = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("note"), w))) if words else F.lit(0)
    return mine.withColumn("score", score).orderBy(F.col("score").desc(), F.col("at").desc(), "note").limit(k)
