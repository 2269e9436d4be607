"""Citation markers: ``[FRAME:t=1.0]``, ``[TRANSCRIPT:t=1.0-2.0]``, ``[SLIDE:t=1.0]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
ANY = rf"\[(?:FRAME:t={NUMBER}|SLIDE:t={NUMBER}|TRANSCRIPT:t={NUMBER}-{NUMBER})\]"


def extract(c) -> Column:
    """All markers in text order: ``array<struct<raw, kind, t_start, t_end>>``."""
    raw = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(ANY), 0)

    def one(m):
        a = F.regexp_extract(m, rf"t=({NUMBER})", 1).cast("double")
        b = F.coalesce(F.regexp_extract(m, rf"-({NUMBER})\]", 1).try_cast("double"), a)
        kind = F.lower(F.regexp_extract(m, r"\[([A-Z]+):", 1))
        return F.struct(m.alias("raw"), kind.alias("kind"), F.least(a, b).alias("t_start"), F.greatest(a, b).alias("t_end"))

    return F.transform(raw, one)


def frame_times(c) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(rf"\[FRAME:t=({NUMBER})\]"), 1), lambda t: t.cast("double"))


def marker(kind, start, end) -> Column:
    slide = F.format_string("[SLIDE:t=%.1f]", col(start))
    span = F.format_string("[TRANSCRIPT:t=%.1f-%.1f]", col(start), col(end))
    frame = F.format_string("[FRAME:t=%.1f]", col(start))
    return F.when(col(kind) == "slide", slide).when(col(kind) == "transcript", span).otherwise(frame)
