"""Durations, bucket periods and windows of time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bucket periods.
PERIODS = {"seconds": "second", "minutes": "minute", "hours": "hour", "days": "day"}
PERIOD_MS = {"seconds": 1_000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}
#: Spellings of duration units.
_UNITS = {"ms": 1, "s": 1_000, "second": 1_000, "m": 60_000, "min": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000}
_DURATION = re.compile(r"\s*(\d+)\s*([a-z]+?)s?\s*$", re.I)


def duration_unit(text: str) -> tuple[int, int]:
    """(count, unit in ms) of a duration such as `1h` or `30 minutes`."""
    m = _DURATION.match(text)
    unit = (m.group(2).lower() if m else "").replace("milli", "ms")
    if m and m.group(0).strip().lower().endswith("ms"):
        unit = "ms"
    if not m or unit not in _UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return int(m.group(1)), _UNITS[unit]


def duration_ms(text: str) -> int:
    count, unit = duration_unit(text)
    return count * unit


def window(duration: str, now_ms: int, rounding: str = "none") -> tuple[int, int]:
    """[start, end] of the last `duration` before `now_ms`; only the start is rounded, to the duration's unit."""
    count, unit = duration_unit(duration)
    start = now_ms - count * unit
    if rounding == "floor":
        start -= start % unit
    elif rounding == "ceiling":
        start += -start % unit
    elif rounding != "none":
        raise ValueError(f"unknown rounding: {rounding}")
    return start, now_ms


def bucket_size(duration: str) -> str:
    """The period that suits a dashboard window of `duration`."""
    ms = duration_ms(duration)
    if ms < 3_600_000:
        return "minutes"
    return "hours" if ms <= 86_400_000 else "days"


def bucket_start(ts: Column, period: str, zone: str = "UTC") -> Column:
    """Start of the bucket of `ts` in `zone`, as epoch milliseconds."""
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period}")
    at = ts.cast("timestamp")
    if zone == "UTC" or period == "seconds":
        return F.unix_millis(F.date_trunc(PERIODS[period], at))
    return F.unix_millis(F.to_utc_timestamp(F.date_trunc(PERIODS[period], F.from_utc_timestamp(at, zone)), zone))


def next_buckets(first: Column, last: Column, period: str, zone: str = "UTC") -> Column:
    """All bucket starts (epoch ms) from `first` to `last`; days follow the zone's clock."""
    if period != "days" or zone == "UTC":
        return F.sequence(first, last, F.lit(PERIOD_MS[period]).cast("long"))
    local = lambda c: F.from_utc_timestamp(F.timestamp_millis(c), zone)
    days = F.sequence(local(first), local(last), F.expr("interval 1 day"))
    return F.transform(days, lambda d: F.unix_millis(F.to_utc_timestamp(d, zone)))
