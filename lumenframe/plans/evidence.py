"""Evidence of a session as typed arrays, and the operators on them.

A session is one row; what it holds is capped by contract (36 frames, 20 texts a
kind, 12 notes, the frames of one video), so these are column expressions and
sessions run side by side without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import mcq
from ..functions.markers import marker
from ..functions.numeric import even_indices, let
from ..functions.text import col, contains_any, contains_tokens, content_tokens, normalize, token_hits
from .planner import MAX_FRAMES
from .predicates import is_audiovisual_question, is_ranking_question

MAX_TEXTS, MAX_NOTES, MAX_WINDOWS, FOCUS_FRAMES, STITCHED_FRAMES = 20, 12, 4, 12, 24
FRAME = "array<struct<timestamp: double, source: string, hypothesis: string>>"
SCENE = "array<struct<start: double, end: double, caption: string>>"
TEXT = "array<struct<kind: string, t_start: double, t_end: double, text: string, score: double>>"
NOTE = "array<struct<tool: string, observation: string, timestamps: array<double>>>"
# fixed values: relations that a question asks for
NOT_SEEN, NOT_HEARD = ("mentioned but not visible",), ("not mentioned", "not said", "没有提到")


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def either(c, kind: str) -> Column:
    """The array, empty where it's null."""
    return F.coalesce(col(c), empty(kind))


def first_of(items: Column, key) -> Column:
    """The first item of every key, in order."""
    return let(items, lambda xs: let(F.transform(xs, key), lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, F.element_at(ks, i + 1)) == i + 1)))


def sorted_by(items: Column, key) -> Column:
    """Items by key; equal ones keep their order. Items themselves are never compared."""
    order = lambda xs: F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    return let(items, lambda xs: F.transform(order(xs), lambda t: F.element_at(xs, t["i"] + 1)))


def evenly(items: Column, limit: int) -> Column:
    """``limit`` items at equal steps; all if they fit."""
    return let(items, lambda xs: F.transform(even_indices(F.size(xs), limit), lambda i: F.element_at(xs, (i + 1).cast("int"))))


def merge_frames(old, new, limit: int = MAX_FRAMES) -> Column:
    """Frames by time, one a tenth of a second, the first seen; evenly thinned to ``limit``."""
    both = F.filter(F.concat(either(old, FRAME), either(new, FRAME)), lambda f: f["timestamp"].isNotNull())
    at = F.transform(both, lambda f: F.struct(F.bround(f["timestamp"], 1).alias("timestamp"), f["source"].alias("source"), f["hypothesis"].alias("hypothesis")))
    return evenly(sorted_by(first_of(at, lambda f: f["timestamp"]), lambda f: f["timestamp"]), limit)


def merge_scenes(old, new) -> Column:
    """Scenes by start, one a pair of start and end at two decimals, the first seen."""
    both = F.filter(F.concat(either(old, SCENE), either(new, SCENE)), lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return sorted_by(first_of(both, lambda s: F.struct(F.bround(s["start"], 2), F.bround(s["end"], 2))), lambda s: s["start"])


def merge_texts(old, new, limit: int | None = MAX_TEXTS) -> Column:
    """Texts by kind and time, one a (kind, start, end, first 80 characters), the best score and then the first; the earliest ``limit``."""
    both = F.filter(F.concat(either(old, TEXT), either(new, TEXT)), lambda t: (F.coalesce(t["kind"], F.lit("")) != "") & (F.trim(F.coalesce(t["text"], F.lit(""))) != ""))

    def whole(t):
        start = F.bround(F.coalesce(t["t_start"], F.lit(0.0)), 2)
        end = F.bround(F.coalesce(t["t_end"], start), 2)
        return F.struct(t["kind"].alias("kind"), start.alias("t_start"), end.alias("t_end"), t["text"].alias("text"), F.coalesce(t["score"], F.lit(0.0)).alias("score"))

    key = lambda t: F.struct(t["kind"], t["t_start"], t["t_end"], F.substring(F.trim(t["text"]), 1, 80))
    # the best first, so the first of a key is its best
    best = first_of(sorted_by(F.transform(both, whole), lambda t: -t["score"]), key)
    kept = sorted_by(best, lambda t: F.struct(t["kind"], t["t_start"], t["t_end"]))
    return kept if limit is None else F.slice(kept, 1, limit)


def text_evidence(transcripts, slides) -> Column:
    """Transcripts, then slides, each merged."""
    return F.concat(merge_texts(empty(TEXT), transcripts), merge_texts(empty(TEXT), slides))


def append_note(notes, tool: Column, observation: Column, timestamps: Column, most: int = MAX_NOTES) -> Column:
    """The last ``most`` notes that say something, the new one at the end."""
    kept = F.filter(either(notes, NOTE), lambda n: F.trim(F.coalesce(n["observation"], F.lit(""))) != "")
    new = F.struct(tool.alias("tool"), observation.alias("observation"), F.transform(timestamps, lambda t: F.bround(t, 1)).alias("timestamps"))
    both = F.concat(kept, F.array(new))
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)


def timeline(scenes, frames) -> Column:
    """``array<struct<at, type, end, caption, source>>`` of scenes and frames by time; scenes before frames."""
    a = F.transform(either(scenes, SCENE), lambda s: F.struct(s["start"].alias("at"), F.lit("scene").alias("type"), s["end"].alias("end"), s["caption"].alias("caption"), F.lit(None).cast("string").alias("source")))
    b = F.transform(either(frames, FRAME), lambda f: F.struct(f["timestamp"].alias("at"), F.lit("frame").alias("type"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("caption"), F.coalesce(f["source"], F.lit("evidence")).alias("source")))
    return sorted_by(F.concat(a, b), lambda e: e["at"])


def evidence_items(transcripts, slides, scenes) -> Column:
    """``array<struct<kind, t, text, marker>>``: transcripts, slides, scenes; blank texts are left out."""

    def items(c, kind: str, start: str, end: str, text: str):
        full = F.filter(c, lambda x: F.trim(F.coalesce(x[text], F.lit(""))) != "")
        if kind == "scene":
            mark = lambda x: F.format_string("scene@%.1f", F.coalesce(x[start], F.lit(0.0)))
        else:
            mark = lambda x: marker(F.lit(kind), F.coalesce(x[start], F.lit(0.0)), F.coalesce(x[end], x[start], F.lit(0.0)))
        return F.transform(full, lambda x: F.struct(F.lit(kind).alias("kind"), F.bround(F.coalesce(x[start], F.lit(0.0)), 1).alias("t"), x[text].alias("text"), mark(x).alias("marker")))

    return F.concat(
        items(either(transcripts, TEXT), "transcript", "t_start", "t_end", "text"), items(either(slides, TEXT), "slide", "t_start", "t_end", "text"),
        items(either(scenes, SCENE), "scene", "start", "end", "caption"),
    )


def timeline_candidates(question) -> Column:
    """Labelled events, else the options of a ranking question, else none."""
    events, options = mcq.events(question), mcq.options(question)
    return F.when(F.size(events) > 0, events).when(is_ranking_question(col(question)), options).otherwise(empty(mcq.ITEM))


def candidate_rows(candidates: Column, items: Column) -> Column:
    """``array<struct<label, text, status, t, kind, marker, hits>>``: each candidate's best evidence: most tokens, then the earliest, then the first."""

    def best(tokens, items):
        scored = F.transform(items, lambda e, i: F.struct(token_hits(F.lower(e["text"]), tokens).alias("hits"), (-e["t"]).alias("nt"), (-i).alias("ni")))
        return F.array_max(F.filter(scored, lambda s: (F.size(tokens) > 0) & (s["hits"] >= F.when(F.size(tokens) <= 2, 1).otherwise(2))))

    def row(c, b, items):
        at = F.try_element_at(items, 1 - b["ni"])
        return F.struct(
            c["label"].alias("label"), c["text"].alias("text"), F.when(b.isNull(), "missing").otherwise("found").alias("status"), at["t"].alias("t"), at["kind"].alias("kind"),
            at["marker"].alias("marker"), F.coalesce(b["hits"], F.lit(0)).alias("hits"),
        )

    found = lambda items, c: let(let(content_tokens(c["text"]), lambda tokens: best(tokens, items)), lambda b: row(c, b, items))
    return let(items, lambda xs: F.transform(candidates, lambda c: found(xs, c)))


def found_order(rows: Column) -> Column:
    """Labels of the found candidates by time; equal times keep their order."""
    return F.transform(sorted_by(F.filter(rows, lambda r: r["status"] == "found"), lambda r: r["t"]), lambda r: r["label"])


def coverage_ok(rows: Column) -> Column:
    return (F.size(rows) > 0) & F.forall(rows, lambda r: r["status"] == "found")


def timeline_option(rows: Column, options: Column) -> Column:
    """The option that gives the candidates in the order found; null unless all are found."""
    return let(rows, lambda rs: F.when(coverage_ok(rs), let(F.transform(found_order(rs), lambda x: F.lower(x)), lambda order: mcq.temporal_option(options, order))))


def first_hit(tokens: Column, items: Column, texts: Column) -> Column:
    """The item that shows an option: the first with its first six tokens, else the one with most of them, two at least.

    ``texts`` are the items' normalized texts.
    """

    def pick(distinct):
        full = F.array_min(F.transform(texts, lambda x, i: F.when(contains_tokens(x, tokens), i)))
        count = F.array_max(F.transform(texts, lambda x, i: F.struct(token_hits(x, distinct).alias("n"), (-i).alias("ni"))))
        some = let(count, lambda c: F.when((F.size(distinct) > 0) & (c["n"] >= F.least(F.lit(2), F.size(distinct))), -c["ni"]))
        return F.coalesce(full, some)

    return F.try_element_at(items, let(F.array_distinct(tokens), pick) + 1)


MATRIX = "array<struct<label: string, visual: boolean, audio: boolean, decision: string, marker: string>>"


def audiovisual_matrix(question, options: Column, slides: Column, transcripts: Column) -> Column:
    """``array<struct<label, visual, audio, decision, marker>>`` of a question that compares sound and picture, else empty.

    An option counts as seen with a hit, or if the slides' joined text holds its first six tokens.
    """
    q = F.lower(F.coalesce(col(question), F.lit("")))
    texts = lambda items: F.transform(items, lambda e: normalize(e["text"]))

    def row(o, tokens, s, t, s_texts, t_texts):
        joined = lambda xs: contains_tokens(F.array_join(xs, " "), tokens)
        decide = lambda seen, heard: (
            F.when(contains_any(q, NOT_SEEN), F.when(heard & ~seen, "match").otherwise("reject"))
            .when(contains_any(q, NOT_HEARD), F.when(seen & ~heard, "match").otherwise("reject"))
            .otherwise(F.when(seen & heard, "match").otherwise("unknown"))
        )

        def made(slide, seen, heard):
            return F.struct(o["label"].alias("label"), seen.alias("visual"), heard.alias("audio"), decide(seen, heard).alias("decision"), slide["marker"].alias("marker"))

        heard = first_hit(tokens, t, t_texts).isNotNull() | joined(t_texts)
        return let(first_hit(tokens, s, s_texts), lambda slide: let(slide.isNotNull() | joined(s_texts), lambda seen: let(heard, lambda h: made(slide, seen, h))))

    rows = lambda s, t: let(texts(s), lambda st: let(texts(t), lambda tt: F.transform(options, lambda o: let(content_tokens(o["text"]), lambda k: row(o, k, s, t, st, tt)))))
    return F.when(is_audiovisual_question(q) & (F.size(options) > 0), let(slides, lambda s: let(transcripts, lambda t: rows(s, t)))).otherwise(F.array().cast(MATRIX))


def dense_frames(available: Column, targets: Column, window: Column | float, most: int, source: str) -> Column:
    """Frames of the video within ``window`` seconds of a target, each once, evenly thinned to ``most``."""
    w = F.greatest(F.lit(0.0), window if isinstance(window, Column) else F.lit(float(window)))
    hit = lambda t, xs: F.exists(xs, lambda x: (t >= F.greatest(x - w, F.lit(0.0))) & (t <= x + w))
    near = let(targets, lambda xs: F.filter(F.array_sort(F.array_distinct(available)), lambda t: hit(t, xs)))
    return F.transform(evenly(near, most), lambda t: F.struct(t.alias("timestamp"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("hypothesis")))


def focus_window(center: Column, half: Column, duration: Column) -> Column:
    """``struct<start, end, center>`` around a time, within the video where its length is known."""
    h, c = F.greatest(F.coalesce(half, F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(center, F.lit(0.0)), F.lit(0.0))
    end = F.when(duration > 0, F.least(duration, c + h)).otherwise(c + h)
    start = F.least(F.greatest(c - h, F.lit(0.0)), end)
    return F.struct(F.bround(start, 2).alias("start"), F.bround(end, 2).alias("end"), F.bround((start + end) / 2.0, 2).alias("center"))


def stitched_windows(windows: Column) -> tuple[Column, Column]:
    """The first four valid windows in order, ends swapped where needed, and a warning if more were given."""
    good = F.filter(windows, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    a = lambda w: F.greatest(w["start"], F.lit(0.0))
    b = lambda w: F.greatest(w["end"], F.lit(0.0))
    made = F.array_sort(F.transform(good, lambda w: F.struct(F.bround(F.least(a(w), b(w)), 2).alias("start"), F.bround(F.greatest(a(w), b(w)), 2).alias("end"))))
    return F.slice(made, 1, MAX_WINDOWS), F.when(F.size(made) > MAX_WINDOWS, F.lit(f"truncated to {MAX_WINDOWS} windows"))


def stitched_frames(available: Column, windows: Column, fps: float = 1.0, most: int = STITCHED_FRAMES) -> tuple[Column, Column]:
    """Frames of all windows, at most ``fps`` a second each, merged and thinned to ``most``; and ``struct<start, end, frame_count>`` of each window."""

    def one(w, all_):
        return let(F.filter(all_, lambda t: (t >= w["start"]) & (t <= w["end"])), lambda inside: thinned(w, inside))

    def thinned(w, inside):
        # a window's cap grows with its length, so the thinning is by index
        cap = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((w["end"] - w["start"]) * fps).cast("int") + 1))
        n = F.size(inside)
        step = F.try_divide((n - 1).cast("double"), (cap - 1).cast("double"))
        at = F.when(n <= cap, F.sequence(F.lit(0), n - 1)).when(cap == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), cap - 1), lambda i: F.least(n - 1, F.bround(i * step).cast("int"))))
        picked = F.when(n > 0, F.transform(F.array_sort(F.array_distinct(at)), lambda i: F.element_at(inside, i + 1))).otherwise(F.array().cast("array<double>"))
        return F.transform(picked, lambda t: F.struct(t.alias("timestamp"), F.lit("stitched_verify").alias("source"), F.lit(None).cast("string").alias("hypothesis")))

    every = F.array_sort(F.array_distinct(available))
    frames = merge_frames(empty(FRAME), let(every, lambda all_: F.flatten(F.transform(windows, lambda w: one(w, all_)))), most)
    count = lambda w, fs: F.size(F.filter(fs, lambda f: (f["timestamp"] >= w["start"]) & (f["timestamp"] <= w["end"])))
    return frames, let(frames, lambda fs: F.transform(windows, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), count(w, fs).alias("frame_count"))))


def span(times: Column) -> Column:
    """Largest less smallest time; 0 below two times."""
    return F.when(F.size(times) >= 2, F.array_max(times) - F.array_min(times)).otherwise(F.lit(0.0))


def in_ranges(items: Column, ranges: Column, start: str, limit: int | None = None) -> Column:
    """Items whose time lies in any of the closed ranges (all without ranges), the first ``limit``."""
    kept = F.filter(items, lambda x: (F.size(ranges) == 0) | F.exists(ranges, lambda r: (x[start] >= r["start"]) & (x[start] <= r["end"])))
    return kept if limit is None else F.slice(kept, 1, limit)


def clean_scenes(scenes: Column, duration: Column) -> Column:
    """Scenes within the video; those that end before they start are left out."""
    inside = F.transform(scenes, lambda s: F.struct(F.greatest(s["start"], F.lit(0.0)).alias("start"), F.when(duration > 0, F.least(s["end"], duration)).otherwise(s["end"]).alias("end")))
    return F.filter(inside, lambda s: s["end"] > s["start"])


def frame_refs(frames) -> Column:
    """Frames without their pictures."""
    return F.transform(either(frames, FRAME), lambda f: F.struct(f["timestamp"].alias("timestamp"), f["source"].alias("source"), f["hypothesis"].alias("hypothesis")))


def render_texts(texts: Column, most: int = 12) -> Column:
    """The first lines ``marker text``."""
    line = lambda t: F.concat(marker(t["kind"], t["t_start"], t["t_end"]), F.lit(" "), F.trim(t["text"]))
    return F.array_join(F.transform(F.slice(texts, 1, most), line), "\n")
