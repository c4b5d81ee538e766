"""Columns of time: parsing, formatting, clamping, publication slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def ts_to_seconds(text: Column) -> Column:
    """``mm:ss``, ``hh:mm:ss`` or plain seconds; null if a part is missing, negative or no number."""
    parts = F.split(F.trim(text), ":")
    a, b, c = (_number(F.get(parts, F.lit(k))) for k in range(3))
    ok = lambda x: (x >= 0) & ~F.isnan(x)
    n = F.size(parts)
    return (
        F.when((n == 1) & ok(a), a).when((n == 2) & ok(a) & ok(b), a * 60 + b).when((n == 3) & ok(a) & ok(b) & ok(c), a * 3600 + b * 60 + c)
    )


def seconds_to_ts(seconds: Column) -> Column:
    """``mm:ss``, from an hour on ``hh:mm:ss``."""
    s = F.round(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))


def seconds_to_cs(seconds: Column) -> Column:
    """``h:mm:ss.cc``; null, NaN and negative values are zero."""
    value = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), 0.0).otherwise(seconds)
    cs = F.bround(value * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def duration_fmt(seconds: Column) -> Column:
    """``m:ss``; N/A without a positive duration."""
    s = seconds.cast("long")
    return F.when(s > 0, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise("N/A")


def safe_float(text: Column, default: float, low: float | None = None, high: float | None = None) -> Column:
    """A number inside [low, high]; the default for anything else."""
    value = text.try_cast("double")
    value = F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def hook_seconds_target(wpm: Column) -> Column:
    """Length of a spoken hook, 20 to 70 seconds, shorter for faster speech."""
    return F.greatest(F.lit(20), F.least(F.lit(70), F.round(7000 / F.greatest(wpm, F.lit(1))).cast("int")))


def publish_slot(now: Column, hour: int = 23, minute: int = 30, offset_minutes: int = 330, lead_minutes: int = 10) -> Column:
    """The next daily slot of a fixed offset that is at least lead_minutes ahead, in UTC."""
    shift = F.make_interval(mins=F.lit(offset_minutes))
    slot = F.date_trunc("day", now + shift) + F.make_interval(hours=F.lit(hour), mins=F.lit(minute)) - shift
    late = slot < now + F.make_interval(mins=F.lit(lead_minutes))
    return F.when(late, slot + F.make_interval(days=F.lit(1))).otherwise(slot)
