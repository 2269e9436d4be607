"""Lenient readings of what models and tools hand over: numbers, JSON, deltas, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, squeeze

DELTA_MARK = "SUBJECT_DELTAS:"
DELTA = "struct<op: string, id: string, label: string, first_seen_t: double, last_seen_t: double, attributes: array<string>, evidence_frames: array<double>, attributes_add: array<string>, evidence_frames_add: array<double>>"
CITATION = r"\[(?:FRAME|SLIDE|TRANSCRIPT):t=[0-9.]+(?:-[0-9.]+)?\]"
# fixed values: question kinds of a public benchmark and their modality
MODALITIES = {
    "Object Recognition": "visual", "Object Reasoning": "visual", "Action Recognition": "visual", "Action Reasoning": "joint", "Counting Problem": "visual", "Attribute Perception": "visual",
    "OCR Problems": "visual", "Spatial Reasoning": "visual", "Spatial Perception": "visual", "Temporal Reasoning": "joint", "Temporal Perception": "joint", "Information Synopsis": "overview",
}
# fixed values: words that option keywords leave out
OPTION_STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "is", "are", "was", "were", "be", "and", "or", "that", "this", "these", "those", "it", "its", "by", "as", "from",
    "into", "than", "all", "any", "both", "each", "every", "most", "some", "no", "not", "one", "two", "three", "kinds", "kind", "same", "number", "largest", "smallest", "more", "less", "several",
)


def float_list(c) -> Column:
    """Numbers of a JSON list or of a comma-separated string; null for blank, and for anything that isn't all numbers."""
    t = F.trim(col(c))
    parts = F.filter(F.transform(F.split(F.regexp_replace(t, r"^\[+|\]+$", ""), ","), lambda x: F.trim(F.translate(x, '"', ""))), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((t != "") & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def strings(c) -> Column:
    """Trimmed strings that aren't blank."""
    return F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def tenths(c) -> Column:
    """Numbers at one decimal; what isn't a number is left out."""
    return F.transform(F.filter(F.coalesce(col(c), F.array().cast("array<double>")), lambda x: x.isNotNull()), lambda x: F.bround(x, 1))


def json_object(c) -> Column:
    """The members of a JSON object as text; empty for anything else."""
    return F.coalesce(F.from_json(F.when(F.trim(col(c)).startswith("{"), col(c)), "map<string,string>"), F.create_map().cast("map<string,string>"))


def subject_deltas(answer) -> Column:
    """``struct<text, deltas>``: an answer without its last line of deltas, and the deltas.

    The JSON stands on that line, or goes on to the end. If it can't be read, all from that line on is left out.
    """
    lines = F.split(F.coalesce(col(answer), F.lit("")), r"\r?\n")
    at = F.array_max(F.transform(lines, lambda x, i: F.when(F.trim(x).startswith(DELTA_MARK), i)))
    before = F.slice(lines, 1, F.coalesce(at, F.lit(0)))
    after = F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0)))
    head = F.trim(F.substring(F.trim(F.try_element_at(lines, at + 1)), len(DELTA_MARK) + 1, 1 << 30))
    whole = F.trim(F.concat(head, F.lit("\n"), F.array_join(after, "\n")))
    parse = lambda x: F.from_json(x, f"struct<deltas: array<{DELTA}>>")["deltas"]
    complete = lambda x: F.try_parse_json(x).isNotNull()
    one, many = complete(head), complete(whole)
    deltas = F.when(one, parse(head)).when(many, parse(whole))
    cut = F.trim(F.array_join(before, "\n"))
    text = F.when(one & parse(head).isNotNull(), F.trim(F.array_join(F.concat(before, after), "\n"))).otherwise(cut)
    none = F.array().cast(f"array<{DELTA}>")
    return F.struct(
        F.when(at.isNull(), F.trim(F.coalesce(col(answer), F.lit("")))).otherwise(text).alias("text"),
        F.when(at.isNull(), none).otherwise(F.coalesce(F.filter(deltas, lambda d: d.isNotNull()), none)).alias("deltas"),
    )


def message_text(c) -> Column:
    """The text of a message: plain, or the text parts of a JSON list."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    parts = F.transform(F.from_json(t, "array<string>"), lambda p: F.when(p.startswith("{"), F.get_json_object(p, "$.text")).otherwise(p))
    return F.when(t.startswith("[") & parts.isNotNull(), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "")).otherwise(F.coalesce(col(c), F.lit("")))


def citation_parts(c) -> Column:
    """``array<struct<text, marker>>``: a text cut at its citations; the last part has no marker."""
    texts, marks = F.split(F.coalesce(col(c), F.lit("")), CITATION), F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(CITATION), 0)
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.try_element_at(marks, i + 1).alias("marker")))


def registry_lines(question, registry) -> Column:
    """A question with the subjects known so far, one a line."""
    line = lambda s: F.format_string("- %s (%s): %s; last seen %.1f s", s["id"], s["label"], F.array_join(s["attributes"], ", "), F.coalesce(s["last_seen"], F.lit(0.0)))
    known = F.concat(F.lit("Known subjects:\n"), F.array_join(F.transform(col(registry), line), "\n"))
    return F.concat_ws("\n\n", F.when(F.size(col(registry)) > 0, known), col(question))


def ocr_text(blocks) -> Column:
    """Lines of slide text: blocks ``struct<text, score>`` that hold any."""
    return F.array_join(F.filter(F.transform(col(blocks), lambda b: F.trim(b["text"])), lambda t: t != ""), "\n")


def ocr_blocks(rows) -> Column:
    """Rows ``[box, text, score]`` of a recognizer, as JSON, to ``array<struct<text, score>>``; malformed ones are left out."""
    parsed = F.transform(F.from_json(col(rows), "array<array<string>>"), lambda r: F.struct(F.try_element_at(r, F.lit(2)).alias("text"), F.try_element_at(r, F.lit(3)).try_cast("double").alias("score")))
    return F.filter(parsed, lambda b: b["text"].isNotNull() & b["score"].isNotNull())


def time_index(t, fps, frames) -> Column:
    """The frame at a time, within the video."""
    return F.greatest(F.lit(0), F.least(col(frames) - 1, F.bround(col(t) * col(fps)).cast("int")))


def frame_name(t) -> Column:
    return F.format_string("t%06.1f.jpg", col(t).cast("double"))


def option_text(c) -> Column:
    """An option without its letter."""
    return F.trim(F.regexp_replace(col(c), r"^[A-E][.)]\s*", ""))


def option_keywords(c, most: int = 3) -> Column:
    """The first distinct telling words of an option; a sequence like ``(a)(b)`` is one; else its whole text."""
    t = F.rtrim(option_text(c), F.lit("."))
    words = F.filter(F.regexp_extract_all(t, F.lit(r"[A-Za-z一-鿿][A-Za-z0-9一-鿿'-]*"), 0), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*OPTION_STOPWORDS))
    lowered = F.transform(words, lambda w: F.lower(w))
    kept = F.slice(F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1), 1, most)
    return F.when(t.rlike(r"^(\([a-zA-Z0-9]\)\s*)+$"), F.array(F.regexp_replace(t, r"\s+", ""))).when(F.size(kept) > 0, kept).otherwise(F.array(t))


def question_with_options(question, opts) -> Column:
    """A question with lettered options, unless it lists candidates already."""
    q = F.trim(col(question))
    lines = F.transform(col(opts), lambda o, i: F.concat(F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)), F.lit(") "), option_text(o)))
    return F.when(F.contains(q, F.lit("Candidates:")), q).otherwise(F.concat(q, F.lit("\n\nCandidates:\n"), F.array_join(lines, "\n")))


def modality(task) -> Column:
    """The modality of a question kind; ``joint`` where it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in MODALITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(task)), F.lit("joint"))


def expected_kinds(task, mode) -> Column:
    m = col(mode)
    lit = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(m.isin("audio", "overview"), lit("transcript")).when(col(task) == "OCR Problems", lit("slide"))
        .when(m == "joint", lit("transcript", "frame_or_slide")).otherwise(lit("frame_or_slide"))
    )


def segment(kind: str, start, end, text, source=None) -> tuple[Column, ...]:
    """``(t_start, t_end, text, source)`` of a segment: ends in order, at three decimals, text trimmed, a default source by kind."""
    a = F.coalesce(col(start).try_cast("double"), F.lit(0.0))
    b = F.coalesce(col(end).try_cast("double"), a)
    default = F.lit({"transcript": "asr", "slide": "ocr"}.get(kind, kind))
    named = F.coalesce(F.when(F.trim(col(source)) != "", col(source)), default) if source is not None else default
    return F.bround(F.least(a, b), 3), F.bround(F.greatest(a, b), 3), F.trim(F.coalesce(col(text), F.lit(""))), named


def clean_line(c) -> Column:
    return squeeze(F.coalesce(col(c), F.lit("")))
