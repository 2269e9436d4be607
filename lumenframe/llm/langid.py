"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It reads
UTF-8 bytes, gives a distribution over the learned languages at every position,
and a document's distribution is the mean over its positions. Gates and
candidates use ``x / (1 + |x|)`` in place of the logistic function and tanh: a
bounded sigmoid of the same kind that costs three vector operations.

Plan: the labelled sample is picked by hash order per language from ids and
labels alone, so only that bounded sample's excerpts reach the driver
(``docs_per_lang`` documents of each language, ``excerpts`` excerpts of each).
Prediction is one Arrow pass over whole texts without a shuffle: texts are cut
into windows that run through the network together.

Null texts and texts without a letter get ``und`` and score 0. If no labelled
row exists, every row does. Repeated rows get equal predictions. Of languages with
equal scores the first in the alphabet wins. Empty labelled texts teach nothing.
An input column with the name of an output column is replaced by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices, table

UND = "und"
HIDDEN = 8
WINDOW = 64
#: Windows that run through the network together.
LANES = 2048
BATCH_BYTES = 4 << 20
DOCS_PER_LANG = 400
EXCERPTS = 6
EXCERPT_CHARS = 48
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions and superscript digits, which the pattern takes too, are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class ByteGRU:
    """``x``: input table (3H, 256) of each direction; ``u``: (3H, H); ``o``: (C, H); ``b``: (C, 1)."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def blank(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> ByteGRU:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = r.normal(0, 0.5, (3 * hidden, 256))
            w["x" + d][:hidden] += 1.0  # keep state at first
            w["u" + d] = r.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden))
            w["o" + d] = r.normal(0, 0.3, (len(langs), hidden))
        w["b"] = np.zeros((len(langs), 1))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, data: np.ndarray, way: str, keep: list | None = None):
        """Yield ``(t, h)`` in reading order of ``way``; ``data`` is (T, B) bytes."""
        x, u = self.weights["x" + way], self.weights["u" + way]
        hid = u.shape[1]
        h = np.zeros((hid, data.shape[1]), np.float32)
        for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
            a, g = x.take(data[t], axis=1), u @ h
            s = a[: 2 * hid] + g[: 2 * hid]
            s /= 1 + np.abs(s)
            zr = s * np.float32(0.5) + np.float32(0.5)
            n = a[2 * hid :] + zr[hid:] * g[2 * hid :]
            n /= 1 + np.abs(n)
            new = n + zr[:hid] * (h - n)
            if keep is not None:
                keep.append((t, h, s, zr, n, g[2 * hid :]))
            h = new
            yield t, h

    def position_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(T, C, B) distributions at every position of (T, B) bytes."""
        w = self.weights
        out = np.empty((len(data), len(self.langs), data.shape[1]), np.float32)
        for t, h in self.states(data, "f"):
            out[t] = w["of"] @ h + w["b"]
        for t, h in self.states(data, "b"):
            p = out[t]
            p += w["ob"] @ h
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
        return out

    def gradients(self, data: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time; ``y``: a class for each column."""
        w, kept = self.weights, {"f": [], "b": []}
        steps, lanes = data.shape
        hs = {d: dict(self.states(data, d, kept[d])) for d in "fb"}
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        delta, loss = {}, 0.0
        for t in range(steps):
            p = w["of"] @ hs["f"][t] + w["ob"] @ hs["b"][t] + w["b"]
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            loss -= float(np.log(p[y, np.arange(lanes)] + 1e-9).sum())
            p[y, np.arange(lanes)] -= 1
            p /= steps * lanes
            delta[t] = p
            grads["of"] += p @ hs["f"][t].T
            grads["ob"] += p @ hs["b"][t].T
            grads["b"] += p.sum(1, keepdims=True)
        for d in "fb":
            u, hid = w["u" + d], w["u" + d].shape[1]
            dh, das, bs = np.zeros((hid, lanes), np.float32), [], []
            for t, h, s, zr, n, gn in reversed(kept[d]):
                dh = dh + w["o" + d].T @ delta[t]
                z, r = zr[:hid], zr[hid:]
                dan = dh * (1 - z) * (1 - np.abs(n)) ** 2
                ds = np.concatenate([dh * (h - n), dan * gn]) * 0.5 * (1 - np.abs(s)) ** 2
                dg = np.concatenate([ds, dan * r])
                das.append(np.concatenate([ds, dan]))
                bs.append(data[t])
                grads["u" + d] += dg @ h.T
                dh = dh * z + u.T @ dg
            da, b = np.concatenate(das, axis=1), np.concatenate(bs)
            for i in range(3 * hid):
                grads["x" + d][i] = np.bincount(b, weights=da[i], minlength=256)
        return loss / (steps * lanes), grads

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int, lanes: int = 128, rate: float = 0.03, seed: int = 0) -> float:
        """Adam over random batches of (N, T) windows."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        loss = 0.0
        for i in range(1, steps + 1):
            pick = r.integers(0, len(windows), lanes)
            loss, g = self.gradients(np.ascontiguousarray(windows[pick].T), y[pick])
            lr = rate * min(1.0, 2 * (1 - (i - 1) / steps))
            for k, w in self.weights.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                w -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(N, C) mean distributions of non-empty texts over all their positions."""
        sizes = np.array([len(t) for t in texts])
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        flat = np.zeros(int(windows.sum()) * WINDOW, np.uint8)
        at = (np.cumsum(windows) - windows) * WINDOW
        for t, a in zip(texts, at, strict=True):
            flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
        used = np.full(len(owner), WINDOW)
        used[np.cumsum(windows) - 1] = sizes - (windows - 1) * WINDOW
        data, sums = flat.reshape(-1, WINDOW), np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(data), LANES):
            part, n = np.ascontiguousarray(data[lo : lo + LANES].T), used[lo : lo + LANES]
            p = self.position_probabilities(part)
            if n.min() < WINDOW:
                p *= (np.arange(WINDOW)[:, None] < n)[:, None, :]
            total = p.sum(0)
            own = owner[lo : lo + LANES]
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(own, weights=total[c], minlength=len(texts))
        return sums / sizes[:, None]

    def label_positions(self, text: str) -> list[str]:
        """The language of every byte position of a text."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        labels = []
        for lo in range(0, len(raw), WINDOW):
            p = self.position_probabilities(raw[lo : lo + WINDOW][:, None])
            labels += [self.langs[i] for i in p[:, :, 0].argmax(1)]
        return labels


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG,
    excerpts: int = EXCERPTS,
    steps: int = 240,
    seed: int = 0,
) -> ByteGRU | None:
    """Fit on a bounded sample of labelled rows outside the held-out quarter; None if there are none."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.where(F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out("i"))
    order = W.partitionBy("l").orderBy(F.xxhash64("i", F.lit(seed)), "i")
    labelled = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l")).where(F.col("l").isNotNull() & F.col("i").isNotNull() & ~held_out("i"))
    # a hash range that holds about twice the wanted ids of each language, so few rows meet in its window
    sizes = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(2.0 * docs_per_lang + 50) / F.col("n")
    thin = labelled.join(F.broadcast(sizes), "l").where(F.pmod(F.xxhash64("i", F.lit(seed + 99)), F.lit(1 << 30)) < share * (1 << 30)).select("i", "l").distinct()
    picked = thin.withColumn("r", F.row_number().over(order)).where(f"r <= {int(docs_per_lang)}").select("i").distinct()
    # at most docs_per_lang ids of each language: its size is bounded by the label set
    some = rows.join(F.broadcast(picked), "i", "left_semi")
    at = [F.pmod(F.xxhash64("i", F.lit(seed + k)), F.greatest(F.length("t"), F.lit(1))).cast("int") + 1 for k in range(1, excerpts + 1)]
    found = some.select("i", "l", F.struct(*[F.col("t").substr(p, F.lit(EXCERPT_CHARS)).alias(f"e{k}") for k, p in enumerate(at)]).alias("e"))
    # rows that repeat an id count once, so the sample stays bounded
    found = found.groupBy("i", "l").agg(F.min("e").alias("e")).select("i", "l", "e.*").collect()
    found = sorted(found, key=lambda r: (r["i"], r["l"]))
    langs = sorted({r["l"] for r in found})
    if not langs:
        return None
    half = WINDOW // 2
    windows, y, per = [], [], {}
    for r in found:
        if per.setdefault(r["l"], 0) >= docs_per_lang:
            continue
        per[r["l"]] += 1
        for k in range(excerpts):
            raw = r[f"e{k}"].encode("utf-8", "replace")
            if len(raw) >= 8 and has_letter(r[f"e{k}"]):
                windows.append((raw * (half // len(raw) + 1))[:half])
                y.append(langs.index(r["l"]))
    if not windows:
        return None
    # every language weighs the same
    y = np.array(y)
    data = np.array([np.frombuffer(x, np.uint8) for x in windows])
    rng = np.random.default_rng(seed)
    most = np.bincount(y, minlength=len(langs)).max()
    pick = np.concatenate([rng.choice(np.flatnonzero(y == c), most) for c in np.unique(y)])
    model = ByteGRU.blank(langs, seed=seed)
    model.fit(data[pick], y[pick], steps, seed=seed)
    return model


def predict(docs: DataFrame, model: ByteGRU | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``lang_out`` and ``score_out``; columns of these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in (lang_out.lower(), score_out.lower()) or f.name == text_col]
    schema = T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    docs = docs.select(*[f.name for f in kept])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                live = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
                if live:
                    p = model.documents([texts[i].encode("utf-8", "replace") for i in live])
                    for i, best, s in zip(live, p.argmax(1), p.max(1), strict=True):
                        lang[i], score[i] = model.langs[best], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, lang_out, score_out])

    return map_arrow(docs, run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)``."""
    model = train(docs, id_col, text_col, lang_col)
    rows = predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return rows.select("id", held_out("id").alias("held_out"), "lang_pred", "score")


def op8_langid(spark, sf_dir) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
