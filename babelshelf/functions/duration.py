"""Durations as day-time intervals: building, parsing, text and arithmetic. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SECONDS = 86_400


def from_seconds(seconds: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def from_minutes(minutes: Column) -> Column:
    return from_seconds(minutes * 60)


def to_seconds(duration: Column) -> Column:
    """Exact seconds; intervals can't be divided by each other, decimals can."""
    return duration.cast("interval second").cast("decimal(18,6)")


def to_minutes(duration: Column, legacy: bool = False) -> Column:
    """Minutes as a double. ``legacy`` counts the microseconds a second time."""
    seconds = to_seconds(duration).cast("double")
    whole = F.floor(to_seconds(duration)).cast("double")
    return (seconds + (seconds - whole if legacy else F.lit(0.0))) / 60


def parse(text: Column) -> Column:
    """``H:M:S`` of one or two digits each, below 24 h; otherwise null."""
    shape = r"^([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$"
    h, m, s = (F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast("int") for k in (1, 2, 3))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), from_seconds(h * 3600 + m * 60 + s))


def parse_seconds(value: Column) -> Column:
    """Whole seconds from 1 to a day; otherwise null."""
    return F.when(value.between(1, MOST_SECONDS), from_seconds(value))


def text(duration: Column) -> Column:
    """``[D day[s], ]H:MM:SS[.ffffff]``; days are negative for durations below zero."""
    micros = (to_seconds(duration) * 1_000_000).cast("long")
    part = F.pmod(micros, F.lit(1_000_000))
    tail = F.when(part == 0, F.lit("")).otherwise(F.format_string(".%06d", part))
    return F.concat(_clock(F.floor(micros / F.lit(1_000_000)).cast("long")), tail)


def _clock(seconds: Column) -> Column:
    days, rest = F.floor(seconds / F.lit(86_400)).cast("long"), F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("long"), F.floor(rest % 3600 / 60).cast("long"), rest % 60)
    many = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), many, clock))


def formatted(duration: Column, spec: str) -> Column:
    """Text with a fixed number of fraction digits, for durations of zero or more.

    ``spec``: empty or ``d`` for whole seconds, 0 to 5 for fraction digits (half to even, carried over), with ``n``
    behind it to leave out a fraction of zero. Others raise ValueError.
    """
    digits = spec.removesuffix("n") or "d"
    if spec in ("", "d"):
        digits = "0"
    if digits not in tuple("012345") or spec == "dn":
        raise ValueError(f"invalid duration format {spec!r}: 'd' or 0 to 5, then perhaps 'n'")
    seconds, n = to_seconds(duration), int(digits)
    if not n:
        return _clock(F.floor(seconds).cast("long"))
    scale = 10**n
    units = F.bround(seconds * scale, 0).cast("long")
    shown = F.concat(_clock(F.floor(units / F.lit(scale)).cast("long")), F.format_string(f".%0{n}d", F.pmod(units, F.lit(scale))))
    return F.when(seconds == F.floor(seconds), _clock(F.floor(seconds).cast("long"))).otherwise(shown) if spec.endswith("n") else shown


def minus_minutes(duration: Column, minutes: Column) -> Column:
    return duration - from_minutes(minutes)


def absolute(duration: Column) -> Column:
    return F.when(duration < F.expr("INTERVAL '0' SECOND"), -duration).otherwise(duration)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a divisor of zero."""
    return F.try_divide(to_seconds(a).cast("double"), to_seconds(b).cast("double"))
