"""Secret scans over an incremental blob ledger.

Every text is a version of its document and is content-addressed by SHA-256.
The ledger holds one row per (blob, rule version): the spans found there. A scan
looks only at blobs that the ledger lacks for the current rules, appends their
findings, and joins findings back to all documents that carry the blob.

Plan: (1) hash texts in the JVM, ids and digests only; (2) one representative
document per unseen blob (a narrow aggregation, so copies never meet in one
task); (3) a semi-join on the document id moves each unseen text once; (4) one
Arrow pass scans; (5) documents join the ledger on the digest, and the paths of a
blob with many copies are dealt over many tasks. The ledger is a Parquet folder
partitioned by rule version; a lost executor only repeats tasks.

Redaction joins the texts with their blobs' findings by digest, dealt in the same way,
and replaces the listed spans; it doesn't search the texts again.

Null text is the empty blob. A null document id can't stand for a blob: such
rows are scanned under the digest of any row with an id, and else keyed by the
digest itself. Repeated rows come out as often as they went in.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, slices, spread_join, table, written

#: Kinds in the order in which spans with an equal start are listed. The first three are the base rules.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "github", "slack", "url_password")
BASE = KINDS[:3]
#: Text that is redacted at once.
BATCH_BYTES = 4 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?<=\n)[A-Za-z][A-Za-z-]*+:[^\n]*+\n|[A-Za-z0-9+/=\s])*+-----END [A-Z ]*PRIVATE KEY-----)?")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "url_password": ("://", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}+://[^\s/@:]*+:([^\s/@]{3,}+)@")),
}
RULES = "1-" + hashlib.sha256("\n".join([_ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, *(p.pattern for _, p in _MORE.values())]).encode()).hexdigest()[:12]

Span = tuple[int, int, str]


def spans(text: str | None) -> list[Span]:
    """``(start, end, kind)`` in code points, by start and then kind."""
    if not text:
        return []
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for kind, (mark, pattern) in _MORE.items():
        if mark in text:
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def parsed(line: str) -> list[Span]:
    """The spans that ``listed`` wrote."""
    parts = (s.split(":") for s in line.split(",") if s)
    return [(int(a), int(b), k) for k, a, b in parts]


def redact(text: str | None, found: list[Span] | None = None) -> str | None:
    """The text with every secret replaced by ``[kind]``; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans(text) if found is None else found:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Findings of ``(blob, text)`` rows; rows that repeat a blob one after the other count once."""

    def run(batches):
        last = None
        for b in batches:
            rows = []
            for blob, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if blob == last:
                    continue
                last = blob
                found = spans(text.as_py())
                base = [s for s in found if s[2] in BASE]
                n = [sum(s[2] == k for s in base) for k in BASE]
                rows.append((blob, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in FINDINGS.split(", ")])

    return map_arrow(blobs, run, FINDINGS)


def blob_of(text) -> F.Column:
    """The content address of a text that isn't null."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


class Ledger:
    """Findings by (blob, rule version) in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: str = RULES):
        self.spark, self.rules = spark, rules
        self.path = path or fresh_path(spark, "ledger")

    def rows(self, blobs: DataFrame | None = None) -> DataFrame:
        """Findings of the current rules, of ``blobs`` only if given; a blob that two runs scanned at once counts once."""
        if not self.known():
            return self.spark.createDataFrame([], FINDINGS)
        found = self.spark.read.schema(FINDINGS).parquet(f"{self.path}/rules={self.rules}")
        if blobs is not None:
            found = found.join(blobs.select("blob"), "blob", "left_semi")
        return found.dropDuplicates(["blob"])

    def known(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rules={self.rules}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Scan the unseen blobs of ``docs`` and keep their findings; ``(id, blob)`` of every row and ``(blob, id, n)`` of every blob."""
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
        blob = blob_of("text").alias("blob")
        paths = written(texts.select("id", blob), "paths")
        blobs = written(paths.groupBy("blob").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "blobs")
        fresh = blobs
        if self.known():
            fresh = written(blobs.join(self.rows(blobs).select("blob"), "blob", "left_anti"), "unseen")
        named = fresh.where("id is not null")
        unseen = texts.select("id", blob, "text").join(named.select("id", "blob").hint("shuffle_hash"), ["id", "blob"], "left_semi").select("blob", "text")
        # copies without id combine before they move
        nameless = texts.where("id is null").select(blob, "text").dropDuplicates(["blob"]).join(fresh.where("id is null").select("blob"), "blob", "left_semi")
        found = scan_blobs(unseen.unionByName(nameless))
        found.write.mode("append").parquet(f"{self.path}/rules={self.rules}")
        return paths, blobs

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, blob, findings...)`` for every row of ``docs``."""
        paths, blobs = self.update(docs, id_col, text_col)
        return spread_join(paths, self.rows(blobs), ["blob"], None, blobs.select("blob", "n"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    return (ledger or Ledger(docs.sparkSession)).scan(docs, id_col, text_col)


def redact_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", ledger: Ledger | None = None) -> DataFrame:
    """All rows of ``docs`` with the secrets that the ledger lists for their blobs replaced.

    ``chars_col`` follows the new length where it changed. Every text meets its blob's findings once, by digest.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    _, blobs = ledger.update(docs, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), blob_of(F.coalesce(text_col, F.lit(""))).alias("blob"))
    rows = spread_join(rows, ledger.rows(blobs).select("blob", "spans"), ["blob"], "id", blobs.select("blob", "n"), "shuffle_hash").select("row", "spans")
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    out = list(docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs is in the way
    flat = rows.select(*[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], "spans")

    def run(batches):
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, BATCH_BYTES):
                *cols, lines = b.slice(lo, hi - lo).columns
                lines = lines.to_pylist()
                if any(lines):
                    old = cols[at].to_pylist()
                    new = [redact(t, parsed(s)) if s else t for t, s in zip(old, lines, strict=True)]
                    cols[at] = pa.array(new, pa.string())
                    if chars is not None:
                        counts = cols[chars].to_pylist()
                        cols[chars] = pa.array([c if o == t else len(t) for c, o, t in zip(counts, old, new, strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=out)

    return map_arrow(flat, run, docs.schema)


def op6_secrets(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
