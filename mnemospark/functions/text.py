"""Column functions on text, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C-U+001F.
SPACE = r"\s\x1c-\x1f"
#: Characters without width that count as blank.
ZERO_WIDTH = r"\u200B-\u200D\u2060\uFEFF"


def strip(c: Column) -> Column:
    """``c`` without surrounding Unicode white space; null stays null."""
    return F.regexp_replace(c, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def norm_key(c: Column) -> Column:
    """``c`` without surrounding white space, in lower case."""
    return F.lower(strip(c))


def is_blank(c: Column) -> Column:
    """True where ``c`` is null or holds only white space and zero-width characters."""
    return c.isNull() | ~F.coalesce(c.rlike(rf"(?U)[^{SPACE}{ZERO_WIDTH}]"), F.lit(False))


def word_count(c: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(rf"(?U)[^{SPACE}]+")), F.lit(0)).cast("long")


def month_of_ms(ms: Column) -> Column:
    """UTC month ``YYYY-MM`` of epoch milliseconds; null and years outside 1-9999 give ``unknown``."""
    ok = ms.between(-62_135_596_800_000, 253_402_300_799_999)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.when(ok, ms) / 86_400_000).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def ms_of(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without a zone, taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
