"""Requests as data, and what happens to one before it becomes a DataFrame plan.

A request is a dict as it comes from JSON, tagged by `opcode`. `prepare` checks it, adds
the default bound on event time, and turns filters on time into a predicate on the day
partition where the table has one, so that the scan reads only the days it needs.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.filters import Filter, conjunction
from tidemark.sources.events import TIME_ALIAS, EventTable

DAY_MS = 86_400_000
#: Actions over a time axis look at the last day unless told otherwise; all others at the past.
LAST_DAY = ("histogram", "trend", "statstrend")
#: Largest page of documents, deepest nesting of statistics.
MAX_DOCUMENTS = 10_000
MAX_NESTING = 10


class RequestError(ValueError):
    """All that is wrong with a request."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


@dataclass(frozen=True)
class Prepared:
    table: EventTable
    request: dict
    filters: tuple[Filter, ...]
    now_ms: int

    @property
    def rows(self) -> DataFrame:
        """The table's rows that pass the filters."""
        # The folders of stored tables are days of UTC, whatever zone the table's buckets follow.
        days = partition_days(self.filters, self.table, self.now_ms, "UTC")
        df = self.table.df
        if days is not None and self.table.date is not None:
            low, high = days
            if low is not None:
                df = df.where(F.col(self.table.date) >= F.lit(low))
            if high is not None:
                df = df.where(F.col(self.table.date) <= F.lit(high))
        return df.where(conjunction(self.filters, self.table, self.now_ms))


def filters_of(request: dict) -> list[Filter]:
    return [Filter.of(f) for f in request.get("filters") or []]


def default_bound(opcode: str, filters: Sequence[Filter], now_ms: int) -> list[Filter]:
    """The bound on event time for a request that names none."""
    if any(f.is_temporal for f in filters):
        return []
    if opcode in LAST_DAY:
        return [Filter("last", TIME_ALIAS, duration="1d", now=now_ms)]
    return [Filter("less_than", TIME_ALIAS, value=now_ms, temporal=True)]


def partition_days(filters: Sequence[Filter], table: EventTable, now_ms: int, zone: str | None = None):
    """First and last day, in `zone` or else the table's, that the filters on event time let through."""
    low = high = None
    for f in filters:
        if not table.is_time(f.field):
            continue
        a, b = f.bounds(now_ms)
        low = a if low is None or (a is not None and a > low) else low
        high = b if high is None or (b is not None and b < high) else high
    day = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).astimezone(ZoneInfo(zone or table.zone)).date()
    return (None if low is None else day(low), None if high is None else day(high))


def days_between(low_ms: int, high_ms: int, zone: str = "UTC") -> list:
    """The day partitions that [low, high] touches."""
    day = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).astimezone(ZoneInfo(zone)).date()
    first, last = day(low_ms), day(high_ms)
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


_NEEDS = {
    "distinct": ("nesting",),
    "group": ("nesting",),
    "trend": ("field",),
    "stats": ("field",),
    "statstrend": ("field",),
    "multi_query": ("requests",),
    "multi_time_query": ("actionRequest", "skipDuration"),
}
OPCODES = ("query", "count", "distinct", "group", "histogram", "trend", "stats", "statstrend", "multi_query", "multi_time_query")


def problems(request: dict) -> list[str]:
    opcode = request.get("opcode")
    if opcode not in OPCODES:
        return [f"unknown opcode: {opcode}"]
    out = [f"{opcode}: {x} is missing" for x in _NEEDS.get(opcode, ()) if not request.get(x)]
    for f in filters_of(request):
        out += f.problems()
    if opcode == "query":
        if not 0 < int(request.get("limit", 10)) <= MAX_DOCUMENTS:
            out.append(f"query: limit must be from 1 to {MAX_DOCUMENTS}")
        if int(request.get("from", 0)) < 0:
            out.append("query: from is negative")
        if request.get("after") is not None and request.get("from"):
            out.append("query: a page after a token has no from")
    if len(request.get("nesting") or []) > MAX_NESTING and opcode in ("stats", "statstrend"):
        out.append(f"{opcode}: nesting is deeper than {MAX_NESTING}")
    if opcode == "multi_query":
        children = [filters_of(r) for r in (request.get("requests") or {}).values()]
        if any(f.is_temporal for f in filters_of(request)) and any(f.is_temporal for c in children for f in c):
            out.append("multi_query: filters on time stand both outside and inside")
        for r in (request.get("requests") or {}).values():
            out += problems(r)
    if opcode == "multi_time_query":
        out += problems(request.get("actionRequest") or {})
        if not any(f.operator == "between" for f in filters_of(request.get("actionRequest") or {})):
            out.append("multi_time_query: a between filter is needed")
    return out


def now_ms(request: dict) -> int:
    return int(request.get("now", time.time() * 1000))


def prepare(table: EventTable, request: dict) -> Prepared:
    found = problems(request)
    if found:
        raise RequestError(found)
    now = now_ms(request)
    filters = filters_of(request)
    opcode, extra = request["opcode"], []
    if opcode == "count" and request.get("field"):
        extra.append(Filter("exists", request["field"]))
    if opcode == "trend" and request.get("values"):
        extra.append(Filter("in", request["field"], values=tuple(request["values"])))
    return Prepared(table, request, (*filters, *default_bound(opcode, filters, now), *extra), now)


def rewritten(table: EventTable, request: dict) -> dict:
    """What would run: the errors, or the filters after defaults. Nothing is executed."""
    found = problems(request)
    if found:
        return {"errors": found}
    return {"errors": [], "filters": [f for f in prepare(table, request).filters]}
