"""Text and number expressions whose results must not depend on the engine's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (Unicode White_Space plus U+001C-U+001F), as a Java regex class.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_EDGES = rf"^{BLANK}+|{BLANK}+$"


def strip(c: Column | str) -> Column:
    """``c`` without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(c, _EDGES, "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-white texts."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def is_finite(c: Column | str) -> Column:
    """True for numbers other than null, NaN and the infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def to_ms(c: Column | str) -> Column:
    """Seconds to whole milliseconds, nearest; null where they don't fit."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1000.0).try_cast("bigint")


def clamp01(c: Column) -> Column:
    """``c`` cut to 0..1; NaN counts as 0."""
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def format_timestamp(seconds: Column) -> Column:
    """``[HH:]MM:SS.mmm``, hours only where there are any; milliseconds are rounded half to even. Parts of a negative
    time count up from a negative hour; a time that is no number of milliseconds gives null."""
    ms = F.bround(seconds * 1000.0).try_cast("bigint")
    part = lambda unit, size: F.pmod(F.floor(ms / F.lit(unit)), F.lit(size))
    hours = F.floor(ms / F.lit(3_600_000))
    short = F.format_string("%02d:%02d.%03d", part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))
    return F.when(hours != 0, F.concat(F.format_string("%02d:", hours), short)).when(hours == 0, short)


def minute_stamp(seconds: Column) -> Column:
    """``[MM:SS]``, whole seconds, minutes without bound."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("[%02d:%02d]", F.floor(s / 60), s % 60)


def path_stem(path: Column) -> Column:
    """The last part of a path without its last suffix (a leading dot begins no suffix)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def is_valid_id(c: Column | str, longest: int = 120) -> Column:
    """True for a text of 1 to ``longest`` characters once trimmed."""
    return F.coalesce(F.length(strip(c)).between(1, longest), F.lit(False))


def is_plain_path(c: Column | str) -> Column:
    """False for names that leave their folder."""
    c = F.col(c) if isinstance(c, str) else c
    return ~(c.contains("/") | c.contains("\\") | (c == "..") | (c == ".") | (c == ""))


def token_budget(seconds: Column, per_second: float = 13.0) -> Column:
    """How many tokens a stretch of speech may have: at least one."""
    return F.greatest(F.lit(1), F.ceil(seconds * F.lit(per_second))).cast("int")


def edge_key(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of an undirected edge in order."""
    return F.least(a, b), F.greatest(a, b)
