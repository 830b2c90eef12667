"""Durations, sizes, dates and number coercion. Malformed input gives null or the stated default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit's names; a year counts as a day, as the reference results require.
UNITS = {("s", "sec", "secs", "second", "seconds"): 1, ("m", "min", "mins", "minute", "minutes"): 60, ("h", "hr", "hrs", "hour", "hours"): 3600, ("d", "day", "days"): 86400, ("w", "week", "weeks"): 604800, ("mo", "month", "months"): 2629746, ("y", "year", "years"): 86400}
SECONDS = {name: n for names, n in UNITS.items() for name in names}
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PART = r"(\d+(?:\.\d+)?)([^\d]+)"


def to_seconds(value: Column) -> Column:
    """Seconds of '2d3h4m5s' and the like; a plain number is seconds; an unknown unit adds nothing; null is 0.

    Parts count from the start on, as long as number and unit alternate; a unit reaches to the next
    digit, blanks included.
    """
    s = F.trim(value.cast("string"))
    # a part must follow on the one before: what isn't matched from the start on ends the sum
    lead = F.regexp_extract(s, rf"^(?:{PART})+", 0)
    numbers = F.regexp_extract_all(lead, F.lit(PART), F.lit(1))
    units = F.regexp_extract_all(lead, F.lit(PART), F.lit(2))

    def part(n: Column, u: Column) -> Column:
        low, scale = F.lower(u), F.lit(0.0)
        for names, seconds in UNITS.items():
            scale = F.when(low.isin(*names), float(seconds)).otherwise(scale)
        return n.cast("double") * scale

    total = F.aggregate(F.zip_with(numbers, units, part), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(s.rlike(FLOAT), s.try_cast("double")).otherwise(total), F.lit(0.0))


def from_metric(value: Column) -> Column:
    """Whole number with K, M or G as powers of 1024; null if it isn't one, or beyond 64 bits."""
    s = F.trim(value.cast("string"))
    scale = F.when(s.endswith("K"), 1024).when(s.endswith("M"), 1024**2).when(s.endswith("G"), 1024**3).otherwise(1).cast("bigint")
    return F.when(s.rlike(r"^[+-]?\d+[KMG]?$"), F.try_multiply(F.regexp_replace(s, "[KMG]$", "").try_cast("bigint"), scale))


def _epoch(s: Column) -> Column:
    """n of /Date(n)/ as seconds; null beyond what dates hold."""
    n = F.regexp_extract(s, r"^/Date\((-?\d{1,11})\)/", 1).try_cast("bigint")
    return F.when(n.between(-62135596800, 253402300799), n)


def to_date(value: Column) -> Column:
    """DATE of /Date(seconds)/, an ISO stamp, yyyymmdd, yyyy-mm-dd..., or m/d/yyyy; else null."""
    s = value.cast("string")
    head = F.when(F.contains(s, F.lit("T")), F.split(s, "T").getItem(0)).when(F.length(s) == 8, F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2))).otherwise(s.substr(1, 10))
    iso = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d"))
    us = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "M/d/yyyy"))
    return F.coalesce(F.timestamp_seconds(_epoch(s)).cast("date"), iso, us)


def to_datetime(value: Column) -> Column:
    """TIMESTAMP (session zone UTC) of the same forms and of ISO stamps with fractions and zones; else null.

    /Date(n)/ loses its time of day, and so does a stamp with a blank for the T.
    """
    s = value.cast("string")
    stamp = F.when(s.rlike(r"^\d{4}(?:-\d\d){2}T\d\d(?::\d\d){2}(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)?$"), F.coalesce(s.try_cast("timestamp")))
    day = F.when(~F.contains(s, F.lit("T")) & ~s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), to_date(s))
    return F.coalesce(F.timestamp_seconds(_epoch(s)).cast("date").cast("timestamp"), stamp, day.cast("timestamp"))


def to_int(value: Column) -> Column:
    """Whole number; null is 0, and so is what isn't one."""
    return F.coalesce(F.when(F.trim(value.cast("string")).rlike(r"^[+-]?\d+$"), F.trim(value.cast("string")).try_cast("bigint")), F.lit(0).cast("bigint"))


def to_float(value: Column) -> Column:
    """Number; null is 0, and so is what isn't one."""
    s = F.trim(value.cast("string"))
    return F.coalesce(F.when(s.rlike(FLOAT), s.try_cast("double")), F.lit(0.0))


def is_float(value: Column) -> Column:
    """Whether it reads as a number: digits, or inf and nan in any case."""
    s = F.lower(F.trim(value.cast("string")))
    return F.coalesce(s.rlike(FLOAT) | s.rlike(r"^[+-]?(inf|infinity|nan)$"), F.lit(False))


def is_int(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")).rlike(r"^[+-]?\d+$"), F.lit(False))


def to_string(value: Column) -> Column:
    """Text; null is empty, /Date(seconds)/ its day."""
    s = value.cast("string")
    return F.coalesce(F.date_format(F.timestamp_seconds(_epoch(s)), "yyyy-MM-dd"), s, F.lit(""))
