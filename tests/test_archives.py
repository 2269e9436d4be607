"""Zip archives as a data source, and scenes from pixels."""

import hashlib
import json
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenframe import udf
from lumenframe.operators import intervals as iv
from lumenframe.plans import evaluation
from lumenframe.sources import files
from lumenframe.sources.archives import SCHEMA, ZipMembers


def test_members_equal_zipfile(spark, tmp_path):
    rng, path = random.Random(3), tmp_path / "in"
    path.mkdir()
    want = {}
    for a in ("x", "y"):
        with zipfile.ZipFile(path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("sub")
            for i in range(20):
                data = bytes(rng.choices(range(256), k=rng.randint(0, 5000)))
                z.writestr(f"sub/{i}.bin", data, zipfile.ZIP_STORED if i % 3 else zipfile.ZIP_DEFLATED)
                want[a, f"sub/{i}.bin"] = data
            z.writestr("z.bz2", b"b" * 100, zipfile.ZIP_BZIP2)
    (path / "bad.zip").write_bytes(b"no archive")
    raw = bytearray((path / "y.zip").read_bytes())
    with zipfile.ZipFile(path / "y.zip") as z:
        hurt = max(z.infolist(), key=lambda i: i.compress_size)
    raw[hurt.header_offset + 200] ^= 255
    (path / "y.zip").write_bytes(raw)
    spark.dataSource.register(ZipMembers)
    df = spark.read.format("zipmembers").option("bytes", 8000).option("names", json.dumps(["sub/3.bin", "gone"])).load(str(path))
    assert df.schema == spark.createDataFrame([], SCHEMA).schema and df.rdd.getNumPartitions() > 6
    rows = df.collect()
    good = {(r["archive"].split("/")[-1][0], r["name"]): bytes(r["content"]) for r in rows if r["error"] is None}
    del want["y", hurt.filename]
    assert good == want
    errors = sorted((r["archive"].split("/")[-1], r["name"] or "", r["error"]) for r in rows if r["error"])
    assert [(a, n) for a, n, _ in errors] == [("bad.zip", ""), ("x.zip", "gone"), ("x.zip", "z.bz2"), ("y.zip", "gone"), ("y.zip", hurt.filename), ("y.zip", "z.bz2")]
    only = spark.read.format("zipmembers").option("pattern", r"sub/1\d").load(f"file://{path}/x.zip")
    assert {r["name"] for r in only.collect()} == {f"sub/{i}.bin" for i in range(10, 20)}


def test_scenes_equal_a_plain_loop(spark):
    rng, rows, want = random.Random(9), [], []
    for video in range(4):
        level, frames = 100, []
        for i in range(120):
            if rng.random() < (0.2 if video < 3 else 0.0):
                level = rng.choice([20, 100, 180])
            frames.append([level + rng.randint(-5, 5) for _ in range(12)])
        rows += [(video, i / 10, f) for i, f in enumerate(frames)]
        last, cuts = 0, [0.0]
        for i in range(1, 120):
            change = sum(abs(a - b) for a, b in zip(frames[i], frames[i - 1], strict=True)) / 12
            if change >= 27 and i - last >= 15:
                last = i
                cuts.append(i / 10)
        if len(cuts) >= 3:
            want += [(video, k, a, b) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], 12.0], strict=True))]
        else:
            want += [(video, 0, 0.0, 10.0), (video, 1, 10.0, 12.0)]
    want.append((9, 0, 0.0, 5.0))  # no frames at all
    df = spark.createDataFrame(rows, "video int, ts double, pixels array<int>")
    durations = spark.createDataFrame([(v, 12.0) for v in range(4)] + [(9, 5.0)], "video int, duration double")
    assert sorted(map(tuple, iv.detect_scenes(df, durations, "video").collect())) == sorted(want)
    assert iv.detect_scenes(df.where("false"), durations.where("false"), "video").isEmpty()
    assert iv.content_change(df, "video").where(F.col("change").isNull()).count() == 4


def test_hashes_lists_and_hits(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc" * 700_000)
    (tmp_path / "b.bin").write_bytes(b"")
    rows = spark.createDataFrame([(f"file://{tmp_path}/a.bin",), (f"{tmp_path}/b.bin",), ("/none",), (None,)], "path string")
    got = {r["path"]: (r["size"], r["sha256"], r["error"]) for r in files.hash_files(rows).collect()}
    assert got[f"file://{tmp_path}/a.bin"] == (2_100_000, hashlib.sha256(b"abc" * 700_000).hexdigest(), None) and got[f"{tmp_path}/b.bin"] == (0, hashlib.sha256(b"").hexdigest(), None)
    assert got["/none"] == got[None] == (None, None, "missing")
    assert {r["error"] for r in files.hash_files(rows.limit(1), most=2_000_000).collect()} == {"too large"}
    (tmp_path / "l.json").write_text('\n [{"a": 1}, {"a": 2}]')
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert files.read_json_list(spark, str(tmp_path / "l.json"), "a int").count() == 2
    with pytest.raises(ValueError):
        files.read_json_list(spark, str(tmp_path / "d.json"), "a int")
    (tmp_path / "n.json").write_text('{"v": {"location":\n {"q": [[1, 2]]}}}')
    assert [tuple(r) for r in files.read_nested(spark, str(tmp_path / "n.json")).collect()] == [("v", "q", [[1.0, 2.0]])]
    chunk = spark.createDataFrame([("t", 1.0, None, "x", 3)], "text string, t_start double, t_end double, filename string, slide_id int")
    assert tuple(files.hit_rows(chunk, F.lit(0.5), "slide").first()) == ("slide", "t", 1.0, 1.0, 0.5, "slide", '{"filename":"x","slide_id":3}')


def test_judge_cache_keeps_no_errors(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()

    def backend(prompt: str) -> str:
        (calls / f"{prompt}-{uuid.uuid4().hex}").touch()
        return '{"correct": true, "score": 4}' if prompt != "bad" else "no idea"

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    for n in (2, 3):  # the error is asked for again
        got = {r["id"]: r["judge"] for r in udf.judge_cached(rows, "id", "prompt", path, backend=backend).collect()}
        assert got[1]["correct"] and got[2]["error"] and len(list(calls.iterdir())) == n


def test_run_meta(spark):
    meta = evaluation.run_meta(spark.range(5), spark.range(3), {"vlm": "m"}, "f", "v", n=5)
    assert (meta["n_cases_total"], meta["n_cases_predicted"], meta["orchestrator_model_name"], meta["dataset"]) == (5, 3, "m", "custom")
