"""The service's data functions on a folder of their own."""

from itertools import count

import pytest

from lumenframe.api import Absent, Denied, Service, sse


@pytest.fixture
def service(spark, tmp_path):
    ticks = count(1)
    return Service(spark, f"file://{tmp_path}/tables", clock=lambda: next(ticks))


def test_users(service):
    ann = service.login(" ann ")
    assert service.login("ann") == ann != service.login("bob")
    with pytest.raises(ValueError):
        service.login("  ")
    assert service.free_name(["ann", "eve"]) == "eve"
    assert service.free_name(["ann", "bob"], seed=1).rsplit("-", 1)[0] in ("ann", "bob")


def test_videos_and_status(service, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"abc")
    v = service.upload("u", f"file://{tmp_path}/a.mp4", 9.0)
    assert v == "ba7816bf8f01cfea"  # SHA-256 of abc
    service.register_video("u", "w", "w.mp4", 5.0)
    service.register_video("u", v, "b.mp4", 8.0)
    assert [tuple(r) for r in service.videos("u").collect()] == [("u", "w", "w.mp4", 5.0, 2), ("u", v, "b.mp4", 8.0, 1)]
    with pytest.raises(ValueError):
        service.upload("u", f"file://{tmp_path}/a.mp4", most=2)
    service.owned_video("u", v)
    with pytest.raises(Denied):
        service.owned_video("other", v)
    with pytest.raises(Absent):
        service.owned_video("u", "none")
    assert service.status(v)["status"] == "absent"
    service.set_status(v, "running")
    service.set_status(v, "failed", "no audio")
    assert service.status(v) == {"status": "failed", "error": "no audio"}
    assert service.progress_events(v)[-1] == sse("progress", {"status": "failed", "error": "no audio"})


def test_sessions_and_messages(service):
    service.register_video("u", "v", "v.mp4")
    a, b = service.create_session("u", "v", "first"), service.create_session("u")
    service.update_session("u", a, {"title": "renamed", "user_id": "thief"})
    got = [(r["session_id"], r["title"], r["filename"]) for r in service.sessions("u").collect()]
    assert got == [(a, "renamed", "v.mp4"), (b, None, None)] and service.sessions("thief").isEmpty()
    with pytest.raises(Denied):
        service.update_session("thief", a, {"title": "x"})
    with pytest.raises(Absent):
        service.messages("u", "none")
    service.append("messages", [(a, 0, "human", "hi", None), (a, 1, "ai", "", True), (a, 2, "tool", "{}", False), (a, 3, "ai", "hello", False), (b, 0, "human", "other", None)])
    assert [tuple(r) for r in service.messages("u", a).collect()] == [(0, "user", "hi"), (3, "assistant", "hello")]


def test_segments_and_answers(service, spark):
    service.append("segments", [("v", "transcript", 1, "b < c", 2.0, 3.5, "asr"), ("v", "transcript", 0, "a", 0.0, 2.0, "asr"), ("v", "slide", 0, "s", 1.0, 1.0, "ocr")])
    assert service.subtitles("v") == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:02.000\na\n\n2\n00:00:02.000 --> 00:00:03.500\nb &lt; c\n"
    assert [r["text"] for r in service.slides("v").collect()] == ["s"] and service.subtitles("none") == "WEBVTT\n"
    scenes = spark.createDataFrame([(0.0, 5.0, [1.0, 0.0]), (5.0, 9.0, [0.0, 1.0])], "start double, end double, embedding array<double>")
    frames = spark.createDataFrame([(1.0, [1.0, 0.1]), (6.0, [0.1, 1.0])], "ts double, embedding array<double>")
    got = service.chat("what?", [1.0, 0.0], scenes, frames, lambda q, t: f"{q} {t}", n=1, k=1)
    assert got == {"answer": "what? [1.0]", "timestamps": [1.0]}
    with pytest.raises(ValueError):
        service.chat(" ", [1.0, 0.0], scenes, frames, lambda q, t: "")


def test_streams_of_a_client(service, spark):
    shown = spark.createDataFrame([("v", 1, "scenes", "Cutting", 0.2), ("v", 2, "speech", "Listening", 1.7), ("w", 3, "x", "x", 0.1)], "video string, ts int, stage string, label string, progress double")
    assert service.preprocess_stream("v", shown) == [sse("error", {"video_id": "v", "detail": "Video is not preprocessing"})]
    service.set_status("v", "running")
    assert service.preprocess_stream("v", shown) == [sse("stage", {"stage": "speech", "label": "Listening", "progress": 1.0})] and service.preprocess_stream("v", shown.where("false")) == []
    service.set_status("v", "failed", "no audio")
    assert service.preprocess_stream("v", shown) == [sse("error", {"video_id": "v", "detail": "failed: no audio"})]
    service.set_status("v", "done")
    assert service.preprocess_stream("v", shown) == [sse("done", {"video_id": "v"})]
    a = service.create_session("u", "v", "t")
    events = [(a, 0, "token", '{"text": "plan"}'), (a, 1, "tool", '{"updates": [{"frames": [1.5]}]}'), (a, 2, "token", '{"text": "Yes"}'), (a, 3, "end", "{}"), ("other", 0, "error", "{}")]
    got = service.chat_stream("u", a, spark.createDataFrame(events, "session string, pos long, kind string, data string"))
    assert got == [sse("frames", {"frames": [1.5], "scene_hits": [], "transcripts": [], "slides": [], "session_id": a}), sse("token", {"text": "Yes"}), sse("done", {"session_id": a})]
    with pytest.raises(Denied):
        service.chat_stream("thief", a, shown)
