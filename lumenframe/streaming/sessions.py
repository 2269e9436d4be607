"""Keyed session state on streams: chat events, subject registries, checkpoints and progress feeds.

A session's state lives in the state store (RocksDB), so a micro-batch may cut a session anywhere and a restart
goes on from the checkpoint. Chat events and deltas carry dense positions ``pos`` from 0 within their session: a row that
comes too early waits in the state until its predecessors are there. Progress and subscriptions are ordered by
event time: rows wait until the watermark passes them. State is dropped after ``ttl_ms`` without a change where given.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..runtime import ship
from .chat import SENT, Fold
from .state import REGISTRY_SIZE, fold_registry

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = {"done": "done", "failed": "error"}
#: Rows that go to the state store in one call.
PIECE = 10_000
REGISTRIES = "session string, upto long, registry string"
FEED = "video string, subscriber string, at long, event string, stage string, item string"


def with_state(spark: SparkSession) -> None:
    """Keyed state of several variables needs the RocksDB store; a store that the session names itself stays."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").startswith("com."):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _written(state, rows: list[tuple], anew: bool) -> None:
    """Rows appended to a list state, or put in place of what it held, in pieces."""
    if anew:
        state.put(rows[:PIECE])
        rows = rows[PIECE:]
    for i in range(0, len(rows), PIECE):
        state.appendList(rows[i : i + PIECE])


class _InOrder(StatefulProcessor):
    """Rows of a session in the order of ``pos``, whatever order they come in; a row that comes twice counts once."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "pos long, waiting boolean", self.ttl_ms)
        self.early = handle.getListState("early", "pos long, kind string, data string", self.ttl_ms)

    def due(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        at, waiting = self.next.get() or (0, False)
        start, fresh, out = at, {}, []
        for pdf in rows:
            for pos, kind, data in zip(pdf["pos"].tolist(), pdf["kind"], pdf["data"], strict=True):
                if pos >= at:
                    fresh[int(pos)] = (kind, data)
        # a call to the store costs a round trip, so rows that wait are written at once, and read only when the first of them may be due
        moves = at in fresh
        if moves and waiting:
            fresh = {pos: (kind, data) for pos, kind, data in self.early.get()} | fresh
        while at in fresh:
            out.append(fresh.pop(at))
            at += 1
        if fresh:
            _written(self.early, [(pos, *row) for pos, row in fresh.items()], anew=moves)
        elif moves and waiting:
            self.early.clear()
        now = (at, bool(fresh) if moves else waiting or bool(fresh))
        if fresh or now != (start, waiting):  # a write also renews the time that state is kept
            self.next.update(now)
        self.at = at
        return out

    def close(self) -> None:
        pass


class ChatFold(_InOrder):
    def init(self, handle) -> None:
        super().init(handle)
        self.state = handle.getValueState("fold", "tools boolean, answered boolean, sent int, holds boolean", self.ttl_ms)
        self.held = handle.getListState("held", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, fold = self.due(rows), Fold()
        if not due and self.ttl_ms is None:
            return
        fold.tools, answered, sent, holds = self.state.get() or (False, False, 0, False)
        fold.answer, fold.held = "x" if answered else "", [t for (t,) in self.held.get()] if holds else []
        out = [e for kind, data in due for e in fold.feed(kind, json.loads(data) if data else {})]
        self.state.update((fold.tools, bool(fold.answer), sent + len(out), bool(fold.held)))
        if fold.held:
            _written(self.held, [(t,) for t in fold.held], anew=True)
        elif holds:
            self.held.clear()
        yield pd.DataFrame([(key[0], sent + i, e, json.dumps(d, ensure_ascii=False)) for i, (e, d) in enumerate(out)], columns=["session", "no", "event", "data"])


class RegistryFold(_InOrder):
    def __init__(self, size: int = REGISTRY_SIZE, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.size = size

    def init(self, handle) -> None:
        super().init(handle)
        self.known = handle.getValueState("registry", "entries string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = self.due(rows)
        if not due:
            return
        old = json.loads((self.known.get() or ("[]",))[0])
        # entries beyond the size are kept until they're shown, as a later update may bring them back
        new = fold_registry([json.loads(d) for _, d in due], 1 << 30, old)
        self.known.update((json.dumps(new, ensure_ascii=False),))
        yield pd.DataFrame([(key[0], self.at, json.dumps(new[: self.size], ensure_ascii=False))], columns=["session", "upto", "registry"])


class Feed(StatefulProcessor):
    """Fan-out of a video's progress: a subscriber gets the latest value once, then what follows until a terminal stage."""

    def __init__(self, every_ms: int = 1000):
        self.every_ms = every_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")  # each a JSON list of up to PIECE (at, rank, item, stage, subscriber)
        self.latest = handle.getValueState("latest", "known boolean, stage string, item string, timer long, heard boolean")
        self.subscribers = handle.getListState("subscribers", "subscriber string")

    def end_of(self, at: int) -> int:
        return (at // 1000 // self.every_ms + 1) * self.every_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, new = None, []
        for r in rows:
            new.append((r["at"], r["rank"], r["item"], r["stage"], r["subscriber"]))
            first = r["at"] if first is None else min(first, r["at"])
            if len(new) == PIECE:
                self.waiting.appendValue((json.dumps(new),))
                new = []
        if new:
            self.waiting.appendValue((json.dumps(new),))
        if first is None:
            return iter(())
        known, stage, item, timer, heard = self.latest.get() or (False, None, None, 0, False)
        if not timer or self.end_of(first) < timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.end_of(first))
            self.latest.update((known, stage, item, self.end_of(first), heard))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # one timer a video, for its first span: all spans that the watermark has passed go together
        passed = timerValues.getCurrentWatermarkInMs() // self.every_ms * self.every_ms
        until = max(expiredTimerInfo.getExpiryTimeInMs(), passed) * 1000
        known, known_stage, known_item, _, heard = self.latest.get() or (False, None, None, 0, False)
        everyone = dict.fromkeys(s for (s,) in self.subscribers.get()) if heard else {}
        # a row that comes twice counts once, as it was written last
        held = {(at, rank, item): (stage, subscriber) for at, rank, item, stage, subscriber in (r for (some,) in self.waiting.get() for r in json.loads(some))}
        rest = [(*k, *v) for k, v in held.items() if k[0] >= until]
        before, out = list(everyone), []
        for (at, rank, item), (stage, subscriber) in sorted((k, v) for k, v in held.items() if k[0] < until):
            if rank == 0:
                known, known_stage, known_item = True, stage, item
                out += [(key[0], s, at, TERMINAL.get(stage, "stage"), stage, item) for s in everyone]
                if stage in TERMINAL:
                    everyone = {}
            elif rank == 1:
                if known:
                    out.append((key[0], subscriber, at, TERMINAL.get(known_stage, "stage"), known_stage, known_item))
                if not known or known_stage not in TERMINAL:
                    everyone[subscriber] = None
            else:
                everyone.pop(subscriber, None)
        if rest:
            self.waiting.put([(json.dumps(rest[i : i + PIECE]),) for i in range(0, len(rest), PIECE)])
        else:
            self.waiting.clear()
        if everyone and list(everyone) != before:
            _written(self.subscribers, [(s,) for s in everyone], anew=True)
        elif before and not everyone:
            self.subscribers.clear()
        timer = self.end_of(min(r[0] for r in rest)) if rest else 0
        if timer:
            self.handle.registerTimer(timer)
        self.latest.update((known, known_stage, known_item, timer, bool(everyone)))
        for row in out:
            yield Row(**dict(zip(("video", "subscriber", "at", "event", "stage", "item"), row, strict=True)))

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str, ttl_ms: int | None) -> DataFrame:
    ship(rows.sparkSession)
    with_state(rows.sparkSession)
    return rows.groupBy("session").transformWithStateInPandas(processor, schema, mode, "ProcessingTime" if ttl_ms else "None")


def fold_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``chat.fold_events`` on a stream of ``(session, pos, kind, data)``: what clients are sent, as soon as it's known."""
    rows = events.select(F.col("session").cast("string").alias("session"), F.col("pos").cast("long").alias("pos"), "kind", "data")
    return _keyed(rows, ChatFold(ttl_ms), SENT, "Append", ttl_ms)


def registry_stream(deltas: DataFrame, size: int = REGISTRY_SIZE, ttl_ms: int | None = None) -> DataFrame:
    """``(session, upto, registry)``: a session's subjects as JSON after each batch that moved them, from ``(session, pos, delta)``."""
    rows = deltas.select(F.col("session").cast("string").alias("session"), F.col("pos").cast("long").alias("pos"), F.lit("delta").alias("kind"), F.col("delta").alias("data"))
    return _keyed(rows, RegistryFold(size, ttl_ms), REGISTRIES, "Update", ttl_ms)


def feed_stream(progress: DataFrame, subscriptions: DataFrame, late: str = "1 minute", every: int = 1) -> DataFrame:
    """What every subscriber is sent, from ``progress (video, ts, stage, item)`` and ``subscriptions (video, ts, subscriber[, leaves])``.

    At one time progress comes before subscriptions. ``item`` names a progress row within its video. Rows later than ``late`` are dropped.
    A video's rows are sent on once the watermark passes the end of their span of ``every`` seconds; wider spans cost fewer timers.
    """
    ship(progress.sparkSession)
    with_state(progress.sparkSession)
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string").alias(c)
    p = progress.select(text("video"), "ts", F.lit(0).alias("rank"), text("item"), text("stage"), none.alias("subscriber"))
    leaves = F.coalesce("leaves", F.lit(False)) if "leaves" in subscriptions.columns else F.lit(False)
    s = subscriptions.select(text("video"), "ts", F.when(leaves, 2).otherwise(1).alias("rank"), text("subscriber").alias("item"), none.alias("stage"), text("subscriber"))
    rows = p.unionByName(s).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    # a video has few rows a batch, which come cheaper one by one than as a data frame
    return rows.groupBy("video").transformWithState(Feed(every * 1000), FEED, "Append", "EventTime").withColumn("at", F.timestamp_micros("at"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an appending stream over all that is there now into Parquet files, each row once whatever fails, and read them."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class CheckpointStore:
    """Session states by thread and step in a shared folder: partial updates are appended, reads fill what they left out."""

    def __init__(self, spark: SparkSession, path: str, *values: str):
        self.spark, self.path, self.values = spark, path, values

    def put(self, updates: DataFrame) -> None:
        """Append ``(thread, step, values...)``; null values leave the state as it was. A step that is put again replaces its values."""
        updates.select("thread", "step", *self.values, F.current_timestamp().alias("put_at"), F.monotonically_increasing_id().alias("put_no")).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy("thread", "step").agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct("put_at", "put_no"))).alias(v) for v in self.values])

    def history(self) -> DataFrame:
        """The whole state after every step."""
        upto = W.partitionBy("thread").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
        return self.log().select("thread", "step", *[F.last(v, True).over(upto).alias(v) for v in self.values])

    def at(self, step: int | None = None) -> DataFrame:
        """The state of every thread, the latest or that after ``step``, to resume from."""
        rows = self.log() if step is None else self.log().where(F.col("step") <= step)
        return rows.groupBy("thread").agg(F.max("step").alias("step"), *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("step"))).alias(v) for v in self.values])

    def fork(self, thread: str, step: int, new: str) -> None:
        """Start another thread from one's state after a step."""
        self.put(self.at(step).where(F.col("thread") == thread).withColumn("thread", F.lit(new)))
