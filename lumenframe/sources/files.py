"""Readers and writers: JSON lines, caches, CSV indexes, subtitles, frame folders."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_escape, vtt_time
from ..runtime import ship


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lenient: malformed lines are dropped; a missing path is empty."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines and ``#`` comments are skipped; a bad line fails the read."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object as ``(key, value)`` rows."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_frames(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, ts)`` of frame files named ``t<seconds>.jpg``, distinct and in numeric order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "t*.jpg").load(pattern).select("path")
    return files.select("path", F.coalesce(F.regexp_extract("path", r"t([0-9]+(?:\.[0-9]+)?)\.jpg$", 1).try_cast("double"), F.lit(0.0)).alias("ts")).distinct().orderBy("ts")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write and give the number of rows written, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def write_segments(df: DataFrame, kind: str, path: str, key: str, order: str, vtt: str | None = None) -> int:
    """Normalized transcripts or slides as JSON lines, and as subtitles where ``vtt`` names a folder; how many rows."""
    from ..functions.parsing import segment

    start, end, text, source = segment(kind, "t_start", "t_end", "text", "source" if "source" in df.columns else None)
    rows = df.withColumns({"_a": start, "_b": end, "_t": text, "source": source}).drop("t_start", "t_end", "text").withColumnsRenamed({"_a": "t_start", "_b": "t_end", "_t": "text"})
    if vtt:
        write_vtt(rows, key, order, vtt)
    return write_jsonl(rows, path)


def append_cache(df: DataFrame, path: str) -> None:
    """Append ``(key, value, seq)`` records; the last of a key is read back."""
    df.write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    rows = read_jsonl(spark, path, f"key string, value {value}, seq long")
    return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV index; ``read_csv_index`` gives the names, which stand in no part file."""
    df.write.mode("append").csv(path)


def read_csv_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document, or the rows of a JSON list."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_nested(spark: SparkSession, path: str, value: str = "array<array<double>>") -> DataFrame:
    """``(video, qid, spans)`` of a document ``{video: {location: {qid: spans}}}``."""
    doc = spark.read.text(path, wholetext=True)
    videos = doc.select(F.explode(F.from_json("value", f"map<string,struct<location: map<string,{value}>>>")).alias("video", "v"))
    return videos.select("video", F.explode("v.location").alias("qid", "spans"))


def resolve_files(wanted: DataFrame, files: DataFrame, name: str = "name", path: str = "path", extensions: tuple[str, ...] = (".mp4", ".mkv", ".webm", ".avi")) -> DataFrame:
    """Each wanted name with the file that fits best: by whole path, by file name, by stem and extension; null if none.

    Names meet files by their stem, so a name is one row, whatever the number of extensions.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    stem = lambda c: F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")
    base, key = F.col("base"), F.col("stem")
    # an extension of another form than the pattern's cuts a file name elsewhere
    cuts = F.array_distinct(F.array_compact(F.array(stem(base), *[F.when(base.endswith(e), F.substr(base, F.lit(1), F.length(base) - len(e))) for e in extensions])))
    asked = wanted.select(name).distinct().withColumn("own", last(F.col(name))).withColumn("stem", stem(F.col("own")))
    there = files.select(F.col(path), last(F.col(path)).alias("base")).withColumn("stem", F.explode(cuts))
    rank = F.when(F.col(path).endswith(F.concat(F.lit("/"), F.col(name))) | (F.col(path) == F.col(name)), -1).when(base == F.col("own"), 0)
    for i, e in enumerate(extensions, 1):
        rank = rank.when(base == F.concat(key, F.lit(e)), i)
    fits = asked.join(there, "stem").select(name, path, rank.alias("rank")).where("rank is not null")
    best = fits.groupBy(name).agg(F.min(F.struct("rank", path)).alias("best")).select(name, F.col(f"best.{path}").alias(path))
    return wanted.join(best, name, "left")


def stage_copies(wanted: DataFrame, files: DataFrame, done: DataFrame, name: str = "name", content: str = "content_id") -> DataFrame:
    """``(name, content_id, status)``: staged, skipped where the content is there already or comes twice, missing where no file is."""
    rows = wanted.join(files, name, "left").join(done.select(content, F.lit(True).alias("_d")).distinct(), content, "left")
    first = F.row_number().over(W.partitionBy(content).orderBy(name)) == 1
    status = F.when(F.col(content).isNull(), "missing").when(F.col("_d").isNotNull() | ~first, "skipped").otherwise("staged")
    return rows.select(name, content, status.alias("status"))


def split_audit(cases: DataFrame, manifest: DataFrame, files: DataFrame, case_id: str = "case_id", video: str = "video") -> tuple[DataFrame, DataFrame]:
    """Cases with their file, and the others with the reason why they are left out."""
    rows = cases.join(manifest, case_id, "left").join(files.select(video, "path"), video, "left")
    reason = F.when(F.col(video).isNull(), "not_in_manifest").when(F.col("path").isNull(), "file_missing")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def write_index(df: DataFrame, path: str, text: str, encoder, *by: str) -> None:
    """Replace a dense index: rows with the ``embedding`` of their text, by partition where ``by`` names columns."""
    from ..udf import encode_text

    made = encode_text(df, text, "embedding", encoder)
    if by:
        write_partition(made, path, *by)
    else:
        made.write.mode("overwrite").parquet(path)


def dense_frame_index(videos: DataFrame, path: str, encoder, fps: float = 1.0) -> None:
    """Frames of every video on a time grid with their ``embedding``, a partition a video."""
    from ..functions.parsing import frame_name
    from ..operators.intervals import time_grid
    from ..udf import encode_images

    rows = time_grid(videos, fps).withColumn("frame", frame_name("ts"))
    write_partition(encode_images(rows, "frame", "embedding", encoder), path, "video_id")


def purge(spark: SparkSession, *paths: str) -> int:
    """Delete files and folders that exist; how many did."""
    n = 0
    for path in paths:
        if exists(spark, path):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def mark_done(spark: SparkSession, path: str) -> None:
    """An empty marker file beside what a run has made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def write_partition(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def vtt_cues(segments: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, cue, block)``: numbered WebVTT cues with escaped text."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    block = F.concat(n.cast("string"), F.lit("\n"), vtt_time("t_start"), F.lit(" --> "), vtt_time("t_end"), F.lit("\n"), html_escape("text"))
    return segments.select(key, n.alias("cue"), block.alias("block"))


def write_vtt(segments: DataFrame, key: str, order: str, path: str) -> None:
    """One text file per key: the header, then its cues in order."""
    cues = vtt_cues(segments, key, order)
    head = cues.select(key).distinct().select(key, F.lit(0).alias("cue"), F.lit("WEBVTT").alias("block"))
    rows = head.unionByName(cues).repartition(key).sortWithinPartitions(key, "cue")
    rows.select(key, F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_json(value, path: str) -> None:
    """A small report, indented by two."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)


def ingest(cases: DataFrame, manifest: DataFrame, files: DataFrame, status: DataFrame, path: str, preprocess: Column, skip: bool = False) -> dict[str, int]:
    """Bind cases to their files, write kept and rejected ones in one job, and give the counts that this job gathered in passing.

    ``manifest (case_id, video)``, ``files (video, path, content_id)`` and ``status (content_id, status)`` say what is there.
    ``preprocess`` is null where a video could be prepared, else why not; with ``skip`` nothing is. ``path/kept=true``
    holds every case with a file, ``path/kept=false`` entries of the manifest with the reason: ``no_case``, ``file_missing`` or
    ``hash_failed``, and cases that failed to prepare, which are kept as well. Counts: rebound, processed, skipped.
    """
    rows = manifest.join(cases.withColumn("_case", F.lit(True)), "case_id", "left").join(files.withColumn("_file", F.lit(True)), "video", "left")
    rows = rows.join(status.select("content_id", F.col("status").alias("_status")), "content_id", "left")
    reason = F.when(F.col("_case").isNull(), "no_case").when(F.col("_file").isNull(), "file_missing").when(F.col("content_id").isNull(), "hash_failed")
    todo = reason.isNull() & (F.coalesce("_status", F.lit("")) != "done") & F.lit(not skip)
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(todo, preprocess))).withColumn("rebound", reason.isNull()).withColumn("processed", todo & preprocess.isNull())
    rows = rows.drop("_case", "_file", "_status")
    seen = Observation("ingest")
    count = lambda c: F.count_if(c)
    counted = rows.observe(seen, count(F.col("rebound")).alias("rebound"), count(F.col("processed")).alias("processed"), count(F.col("reason").isNotNull()).alias("skipped"))
    where = F.filter(F.array(F.when(F.col("rebound"), F.lit(True)), F.when(F.col("reason").isNotNull(), F.lit(False))), lambda x: x.isNotNull())
    counted.withColumn("kept", F.explode(where)).write.mode("overwrite").partitionBy("kept").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def ingest_status(videos: DataFrame, targets: DataFrame, sources: DataFrame, done: DataFrame, error: Column) -> DataFrame:
    """``(video_id, status)`` of an ingest: already-done, done, or ``FAILED: `` and why; ``error`` is null where preparing works.

    ``targets`` and ``sources`` list the videos whose copy or source is there.
    """
    flag = lambda d, name: d.select("video_id").distinct().withColumn(name, F.lit(True))
    rows = videos.join(flag(done, "_d"), "video_id", "left").join(flag(targets, "_t"), "video_id", "left").join(flag(sources, "_s"), "video_id", "left")
    status = (
        F.when(F.col("_d").isNotNull(), "already-done").when(F.col("_t").isNull() & F.col("_s").isNull(), "FAILED: source missing")
        .when(error.isNotNull(), F.concat(F.lit("FAILED: "), error)).otherwise("done")
    )
    return rows.select("video_id", status.alias("status"))


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON list; a document that is no list is refused."""
    if not spark.read.text(path, wholetext=True).where(~F.col("value").rlike(r"^\s*\[")).isEmpty():
        raise ValueError(f"{path} is no JSON list")
    return read_json(spark, path, schema)


CHUNK_BYTES = 1 << 20


def hash_files(files: DataFrame, path: str = "path", most: int = 2 << 30) -> DataFrame:
    """``files`` with ``size``, ``sha256`` and ``error``: content hashed in pieces of 1 MiB, so no file is ever whole in memory.

    A file that grows beyond ``most`` bytes is given up at that point, with the error ``too large``; one that can't be read is ``missing``.
    """
    ship(files.sparkSession)

    def one(name: str) -> tuple[int | None, str | None, str | None]:
        from pyarrow import fs

        try:
            store, base = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(base, compression=None) as f:
                while piece := f.read(CHUNK_BYTES):
                    size += len(piece)
                    if size > most:
                        return None, None, "too large"
                    digest.update(piece)
            return size, digest.hexdigest(), None
        except (OSError, ValueError):
            return None, None, "missing"

    def run(batches):
        for pdf in batches:
            found = [one(x) if x else (None, None, "missing") for x in pdf[path]]
            yield pdf.assign(**{c: pd.array([r[i] for r in found], dtype=t) for i, (c, t) in enumerate((("size", "Int64"), ("sha256", "string"), ("error", "string")))})

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())]))


def hit_rows(rows: DataFrame, score: Column, kind: str) -> DataFrame:
    """Stored chunks as hits: ``kind, text, t_start, t_end, score, source, metadata``, whatever else a row has as JSON in ``metadata``."""
    known = ("kind", "text", "t_start", "t_end", "score", "source")
    rest = [c for c in rows.columns if c not in known]
    start = F.coalesce(F.col("t_start").cast("double"), F.lit(0.0))
    source = F.col("source") if "source" in rows.columns else F.lit(None).cast("string")
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return rows.select(
        F.lit(kind).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), start.alias("t_start"), F.coalesce(F.col("t_end").cast("double"), start).alias("t_end"),
        score.cast("double").alias("score"), F.coalesce(source, F.lit(kind)).alias("source"), meta.alias("metadata"),
    )
