"""Cost-balanced packing of tokenized texts into fixed-length training sequences.

A sequence costs ``linear * length + quadratic * sum(piece length squared)``: a
piece attends within itself. Per block of pieces the longest (dearest) goes
first, each to the lowest-cost sequence that still has room for all of it; where
none has, it is cut and fills the lowest-cost open sequence.

Plan: one Arrow pass, no shuffle. A task tokenizes its rows and packs them in
blocks of about ``block_sequences`` full sequences, so memory is bounded by the
block and by the longest single text. Tokens that don't fill a sequence stay for
the next block; only the end of a partition leaves a rest, which is laid out in
sequences whose lengths are powers of two and so need no padding.

Null text counts as empty: its document is the end id alone. Repeated rows are
packed once per row. Ids may be null or repeat; they're only carried along.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_SEQUENCES = 256
#: Entries of a worker's word cache; it starts anew beyond that.
CACHE_WORDS = 600_000
ENCODE_CHARS = 1 << 20
#: Text that is encoded at once, so most of its words repeat within it.
BATCH_BYTES = 8 << 20

_LETTER_MARK = re.compile(r"[^.,]*[^\W_][.,]").fullmatch


def marked(word: str) -> bool:
    """A word that ends in a letter or digit and one mark.

    A few letters become a letter and a combining sign when they're lower-cased and
    normalized, and a sign joins the mark: such words aren't taken apart.
    """
    if not _LETTER_MARK(word):
        return False
    last = word[-2]
    return last.isascii() or unicodedata.normalize("NFC", last.lower())[-1].isalnum()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Exact ids of a lower-casing tokenizer that never joins across white space.

    Distinct words between blanks are encoded once and kept as little-endian bytes.
    Texts that may hold a special token's string take the tokenizer itself.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = cache_words
        self.cache: dict[str, bytes] = {}
        self.start_anew()

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def pieces_of(self, word: str) -> list[int] | None:
        """Ids of a word that is one token before merging; None if it may not be."""
        if len(word) < 100 and word.isalpha() and word.lower() == word and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return [t.id for t in self.model.tokenize(word if word.isascii() else "".join(_BYTES[b] for b in word.encode()))]
        return None

    def learn(self, words: set[str]) -> None:
        cache, other = self.cache, []
        stems = {w[:-1] for w in words if marked(w)}
        for w in (stems | words).difference(cache):
            ids = self.pieces_of(w)
            if ids is not None:
                cache[w] = np.array(ids, dtype="<u4").tobytes()
            elif not marked(w):
                other.append(w)
        self.encode_joined(other)
        for w in words.difference(cache):  # a letter or digit before a mark always ends its token
            cache[w] = cache[w[:-1]] + cache[w[-1:]]

    def encode_joined(self, words: list[str]) -> None:
        lo = 0
        while lo < len(words):
            hi, size = lo, 0
            while hi < len(words) and (hi == lo or size + len(words[hi]) < ENCODE_CHARS):
                size += len(words[hi]) + 1
                hi += 1
            found = self.tokenizer.encode(" ".join(words[lo:hi]), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            at = np.array([o[0] for o in found.offsets], dtype=np.int64)
            cuts = np.searchsorted(at, np.cumsum([0] + [len(p) + 1 for p in words[lo:hi]]))
            for w, a, b in zip(words[lo:hi], cuts[:-1], cuts[1:], strict=True):
                self.cache[w] = ids[a:b].tobytes()
            lo = hi

    def start_anew(self) -> None:
        self.cache = {"": b""}
        self.encode_joined([".", ","])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text; each distinct word of the batch is looked up once."""
        texts = texts.fill_null("")
        odd = pc.match_substring(texts, "<|")
        words = pc.split_pattern(pc.replace_substring(pc.ascii_lower(pc.if_else(odd, "", texts)), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = set(distinct).difference(self.cache)
        if missing:
            if len(self.cache) + len(missing) > self.limit:
                self.start_anew()
                missing = set(distinct).difference(self.cache)
            self.learn(missing)
        found = list(map(self.cache.__getitem__, distinct))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begin = np.cumsum(size) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = size[codes]
        ends = np.r_[0, np.cumsum(counts)]
        ids = flat[np.repeat(begin[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self.plain(texts[int(i)].as_py())
        return out


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


def balance(lengths: np.ndarray, capacities: np.ndarray, linear: float, quadratic: float):
    """Fill all ``capacities`` (they sum to the lengths): ``(doc, start, length, sequence, offset)`` rows.

    ``lengths[i]`` tokens of piece ``i`` are dealt by descending cost.
    """
    room, cost = capacities.astype(np.int64).copy(), np.zeros(len(capacities))
    used = np.zeros(len(capacities), np.int64)
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[i])
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(left, int(room[s]))
            out.append((int(i), start, take, s, int(used[s])))
            room[s] -= take
            used[s] += take
            cost[s] += linear * take + quadratic * take * take
            start += take
            left -= take
    return out


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Gathers documents' ids and gives packed pieces, a block at a time."""

    def __init__(self, capacity: int, block: int, linear: float, quadratic: float, first_sequence: int):
        self.capacity, self.block, self.linear, self.quadratic = capacity, block, linear, quadratic
        self.next = first_sequence
        self.pieces: list[tuple[int | None, int, int, np.ndarray]] = []  # doc, start, tokens in all, ids
        self.tokens = 0

    def add(self, doc: int | None, ids: np.ndarray):
        """A long document's full sequences leave at once; the rest waits for its block."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            yield self.row(doc, at, total, ids[at : at + self.capacity], self.next, 0)
            self.next += 1
            at += self.capacity
        if at < total:
            self.pieces.append((doc, at, total, ids[at:]))
            self.tokens += total - at
            if self.tokens >= self.block * self.capacity:
                yield from self.flush(False)

    def row(self, doc, start, total, ids, sequence, offset):
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset

    def flush(self, last: bool):
        if not self.tokens:
            return
        full, rest = divmod(self.tokens, self.capacity)
        capacities = np.array([self.capacity] * full + powers(rest))
        lengths = np.array([len(p[3]) for p in self.pieces])
        kept = []
        for i, at, n, s, offset in balance(lengths, capacities, self.linear, self.quadratic):
            doc, start, total, ids = self.pieces[i]
            if s >= full and not last:
                kept.append((doc, start + at, total, ids[at : at + n].copy()))
            else:
                yield self.row(doc, start + at, total, ids[at : at + n], self.next + s, offset)
        self.next += len(capacities) if last else full
        self.pieces, self.tokens = kept, rest if not last else 0


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    block_sequences: int = BLOCK_SEQUENCES,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves (``array<int>``)."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], dtype="<u4")
        packer = Packer(capacity, block_sequences, linear, quadratic, TaskContext.get().partitionId() << 36)
        if with_ids:
            row = packer.row
            packer.row = lambda doc, start, total, ids, s, o: (*row(doc, start, total, ids, s, o), ids.astype(np.int32).tolist())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows: list = []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, BATCH_BYTES):
                for doc, found in zip(ids[lo:hi], enc.encode(texts.slice(lo, hi - lo)), strict=True):
                    rows.extend(packer.add(doc, np.append(found, end)))
                if len(rows) > 10_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.flush(True))
        if rows:
            yield batch(rows)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op4_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
