"""Streams: latest progress by key, windowed counts, ordered registry folds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

REGISTRY_SIZE = 15


def progress(df: DataFrame) -> DataFrame:
    """Progress events with their share clamped to [0, 1]."""
    return df.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress"))))


def latest_progress(events: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """The latest event of each key; on a stream, use update or complete output."""
    return events.groupBy(key).agg(*[F.max_by(v, ts).alias(v) for v in values], F.max(ts).alias(ts))


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event-time counts with a watermark for late rows."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), kind, "n")


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run all that is there now, then give the result table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _numbers(xs) -> list[float]:
    return [round(n, 1) for n in map(_number, xs if isinstance(xs, list) else []) if n is not None]


def _strings(xs) -> list[str]:
    return [t for t in (str(x).strip() for x in (xs if isinstance(xs, list) else [])) if t]


def fold_registry(deltas: list[dict], size: int = REGISTRY_SIZE, known: list[dict] | None = None) -> list[dict]:
    """Subjects after add and update deltas, applied in order to those ``known``; the latest seen first.

    Unknown operations, blank ids and updates of unknown ids do nothing. A time of zero counts as missing where another can stand in.
    """
    by_id = {str(e["id"]): dict(e) for e in known or [] if isinstance(e, dict) and e.get("id")}
    for d in deltas:
        if not isinstance(d, dict):
            continue
        key, op = str(d.get("id") or "").strip(), str(d.get("op") or "").strip().lower()
        first, entry = _number(d.get("first_seen_t")), by_id.get(key)
        if not key or op not in ("add", "update") or op == "update" and entry is None:
            continue
        suffix = "" if op == "add" else "_add"
        attributes, frames = _strings(d.get(f"attributes{suffix}")), _numbers(d.get(f"evidence_frames{suffix}"))
        last = _number(d.get("last_seen_t"))
        if op == "add":
            last = last or first
        if entry is None:
            by_id[key] = {"id": key, "label": d.get("label") or key, "first_seen_t": first, "last_seen_t": last, "attributes": attributes, "evidence_frames": frames}
            continue
        entry["attributes"] = sorted({*_strings(entry.get("attributes")), *attributes})
        entry["evidence_frames"] = sorted({*_numbers(entry.get("evidence_frames")), *frames})
        if last is not None:
            entry["last_seen_t"] = max(_number(entry.get("last_seen_t")) or 0.0, last)
        if op == "add" and first is not None:
            at = _number(entry.get("first_seen_t"))
            entry["first_seen_t"] = first if at is None else min(at, first)
    return sorted(by_id.values(), key=lambda e: -(_number(e.get("last_seen_t")) or 0.0))[:size]


REGISTRY = "thread long, entry_no int, id string, label string, first_seen_t double, last_seen_t double, attributes array<string>, evidence_frames array<double>"


def registries(deltas: DataFrame) -> DataFrame:
    """Registry of every thread from ``(thread, pos, delta json)`` rows, folded in order.

    A thread's deltas are one session's and stay in one task.
    """
    ship(deltas.sparkSession)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fold_registry([json.loads(x) for x in pdf.sort_values("pos")["delta"]])
        cols = [c.split()[0] for c in REGISTRY.split(", ")]
        return pd.DataFrame([{**r, "thread": pdf["thread"].iloc[0], "entry_no": i} for i, r in enumerate(rows)], columns=cols)

    return deltas.groupBy("thread").applyInPandas(fold, REGISTRY)
