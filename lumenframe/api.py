"""Data functions of the service: users, videos, sessions, messages, status, segments and a short answer path.

Tables are append-only Parquet folders below one root; a change is a new row and
readers take the latest row of a key, so writers never rewrite what others read.
A web server, if one is wanted, calls these functions; errors map to its codes
(``Absent`` 404, ``Denied`` 403, ``ValueError`` 400).
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import merge
from .operators.search import two_stage
from .sources.files import exists, hash_files, vtt_cues
from .streaming.chat import fold_events
from .streaming.state import latest_progress
from .streaming.state import progress as clamped

TABLES = {
    "users": "user_id string, username string, at long",
    "videos": "user_id string, video_id string, filename string, duration double, created_at long, at long",
    "sessions": "session_id string, user_id string, video_id string, title string, created_at long, at long",
    "status": "video_id string, status string, error string, at long",
    "messages": "session_id string, pos long, role string, text string, calls_tools boolean",
    "segments": "video_id string, kind string, ord long, text string, t_start double, t_end double, source string",
}
ROLES = {"human": "user", "ai": "assistant"}
SESSION_FIELDS = ("video_id", "title")


class Absent(LookupError):
    pass


class Denied(PermissionError):
    pass


def sse(event: str, data) -> str:
    """One server-sent event."""
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


class Service:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def rows(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def append(self, name: str, rows: DataFrame | Iterable[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), TABLES[name]).coalesce(1)
        df.write.mode("append").parquet(f"{self.root}/{name}")

    # users

    def login(self, username: str) -> str:
        """The id of the trimmed name; a new name gets one. The first writer of a name wins."""
        name = username.strip()
        if not name:
            raise ValueError("empty username")
        own = self.rows("users").where(F.col("username") == name)
        if own.isEmpty():
            self.append("users", [(uuid.uuid4().hex, name, self.clock())])
        return self.rows("users").where(F.col("username") == name).agg(F.min_by("user_id", F.struct("at", "user_id"))).first()[0]

    def free_name(self, pool: list[str], seed: int | None = None) -> str:
        """A name of the pool that nobody has; if all are taken, one with a random suffix."""
        names = self.spark.createDataFrame([(n,) for n in pool], "username string")
        left = sorted(r[0] for r in names.join(self.rows("users"), "username", "left_anti").collect())
        rng = random.Random(seed)
        return rng.choice(left) if left else f"{rng.choice(pool)}-{rng.randrange(16**6):06x}"

    # videos

    def upload(self, user_id: str, path: str, duration: float | None = None, most: int = 2 << 30) -> str:
        """Register a file by the hash of its content, read in pieces; one above ``most`` bytes is refused."""
        found = hash_files(self.spark.createDataFrame([(path,)], "path string"), most=most).first()
        if found["error"] == "missing":
            raise Absent(path)
        if found["error"]:
            raise ValueError(f"{path}: {most} bytes at most")
        video_id = found["sha256"][:16]
        self.register_video(user_id, video_id, path.rsplit("/", 1)[-1], duration)
        return video_id

    def register_video(self, user_id: str, video_id: str, filename: str, duration: float | None = None) -> None:
        """Insert or update; the time of the first row stays."""
        now = self.clock()
        self.append("videos", [(user_id, video_id, filename, duration, now, now)])

    def videos(self, user_id: str | None = None) -> DataFrame:
        """The latest first."""
        rows = self.rows("videos") if user_id is None else self.rows("videos").where(F.col("user_id") == user_id)
        latest = rows.groupBy("user_id", "video_id").agg(F.max_by("filename", "at").alias("filename"), F.max_by("duration", "at").alias("duration"), F.min("created_at").alias("created_at"))
        return latest.orderBy(F.col("created_at").desc(), "user_id", "video_id")

    def set_status(self, video_id: str, status: str, error: str | None = None) -> None:
        if status not in ("running", "done", "failed"):
            raise ValueError(status)
        self.append("status", [(video_id, status, error, self.clock())])

    def status(self, video_id: str) -> dict:
        found = merge.latest(self.rows("status").where(F.col("video_id") == video_id), "video_id", "at", "status", "error").first()
        return {"status": found["status"], "error": found["error"]} if found else {"status": "absent", "error": None}

    def progress_events(self, video_id: str) -> list[str]:
        """The status changes of one video in order, as server-sent events."""
        found = self.rows("status").where(F.col("video_id") == video_id).orderBy("at").collect()
        return [sse("progress", {"status": r["status"], "error": r["error"]}) for r in found]

    def preprocess_stream(self, video_id: str, progress: DataFrame) -> list[str]:
        """What a client that asks now is sent first: an end if there is one, else the latest of ``progress (video, ts, stage, label, progress)``.

        What follows for many clients is ``streaming.sessions.feed_stream``.
        """
        status = self.status(video_id)
        if status["status"] == "absent":
            return [sse("error", {"video_id": video_id, "detail": "Video is not preprocessing"})]
        if status["status"] == "done":
            return [sse("done", {"video_id": video_id})]
        if status["status"] == "failed":
            return [sse("error", {"video_id": video_id, "detail": f"failed: {status['error'] or ''}"})]
        mine = clamped(progress.where(F.col("video") == video_id))
        last = latest_progress(mine, "video", "ts", "stage", "label", "progress").first()
        return [sse("stage", {k: last[k] for k in ("stage", "label", "progress")})] if last else []

    def chat_stream(self, user_id: str, session_id: str, events: DataFrame) -> list[str]:
        """One session's turn as server-sent events, from ``(session, pos, kind, data)``; the session counts as updated if there is an answer."""
        self._owned(self.rows("sessions").where(F.col("session_id") == session_id), user_id, session_id)
        sent = [(r["event"], json.loads(r["data"])) for r in fold_events(events.where(F.col("session") == session_id)).orderBy("no").collect()]
        if any(e == "token" for e, _ in sent):
            self.update_session(user_id, session_id, {})
        return [sse(e, d | {"session_id": session_id} if e in ("frames", "done") else d) for e, d in sent]

    def owned_video(self, user_id: str, video_id: str) -> None:
        self._owned(self.rows("videos").where(F.col("video_id") == video_id), user_id, video_id)

    @staticmethod
    def _owned(rows: DataFrame, user_id: str, key: str) -> None:
        found = rows.agg(F.count(F.lit(1)), F.count_if(F.col("user_id") == user_id)).first()
        if not found[0]:
            raise Absent(key)
        if not found[1]:
            raise Denied(key)

    # sessions

    def create_session(self, user_id: str, video_id: str | None = None, title: str | None = None) -> str:
        key, now = uuid.uuid4().hex, self.clock()
        self.append("sessions", [(key, user_id, video_id, title, now, now)])
        return key

    def update_session(self, user_id: str, session_id: str, fields: dict) -> None:
        """Only ``video_id`` and ``title`` change, others are ignored; the session counts as updated in any case."""
        rows = self.rows("sessions").where(F.col("session_id") == session_id)
        self._owned(rows, user_id, session_id)
        old = rows.orderBy(F.col("at").desc()).first().asDict()
        new = old | {k: v for k, v in fields.items() if k in SESSION_FIELDS} | {"at": self.clock()}
        self.append("sessions", [tuple(new.values())])

    def sessions(self, user_id: str) -> DataFrame:
        """A user's sessions with their video's file name if there is one, the last updated first."""
        rows = self.rows("sessions").where(F.col("user_id") == user_id)
        last = rows.groupBy("session_id", "user_id").agg(*[F.max_by(c, "at").alias(c) for c in ("video_id", "title", "created_at")], F.max("at").alias("updated_at"))
        names = self.videos(user_id).select("user_id", "video_id", "filename", "duration")
        return last.join(names, ["user_id", "video_id"], "left").orderBy(F.col("updated_at").desc(), F.col("created_at").desc(), "session_id")

    def messages(self, user_id: str, session_id: str) -> DataFrame:
        """What a reader sees: no tool results and no turns that only call tools."""
        self._owned(self.rows("sessions").where(F.col("session_id") == session_id), user_id, session_id)
        role = F.coalesce(*[F.when(F.col("role") == k, F.lit(v)) for k, v in ROLES.items()], "role").alias("role")
        kept = self.rows("messages").where((F.col("session_id") == session_id) & (F.col("role") != "tool") & ~F.coalesce("calls_tools", F.lit(False)))
        return kept.select("pos", role, "text").orderBy("pos")

    # segments

    def segments(self, video_id: str, kind: str) -> DataFrame:
        return self.rows("segments").where((F.col("video_id") == video_id) & (F.col("kind") == kind)).orderBy("ord")

    def transcripts(self, video_id: str) -> DataFrame:
        return self.segments(video_id, "transcript")

    def slides(self, video_id: str) -> DataFrame:
        return self.segments(video_id, "slide")

    def subtitles(self, video_id: str) -> str:
        """The WebVTT text of one video's transcript."""
        cues = vtt_cues(self.transcripts(video_id), "video_id", "ord").orderBy("cue").collect()
        return "\n\n".join(["WEBVTT", *[r["block"] for r in cues]]) + "\n"

    # answers

    @staticmethod
    def chat(question: str, query: list[float], scenes: DataFrame, frames: DataFrame, backend: Callable[[str, list[float]], str], n: int = 5, k: int = 12) -> dict:
        """The short path without an agent: coarse-to-fine retrieval, then one model call over at most ``k`` frames."""
        if not question.strip():
            raise ValueError("empty question")
        times = sorted(r["ts"] for r in two_stage(scenes, frames, query, n, k).collect())
        return {"answer": backend(question, times), "timestamps": times}
