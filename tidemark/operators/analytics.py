"""The analytics actions, each a function from a prepared request to a DataFrame.

Rows whose group key is missing form no group. Keys come out as strings. Results are
tables; `tidemark.operators.responses` shapes small ones into nested documents.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import metrics
from tidemark.functions.timeutil import PERIOD_MS, bucket_start, duration_ms, next_buckets
from tidemark.plans.requests import DAY_MS, Prepared, RequestError, filters_of, prepare
from tidemark.sources.events import TIME_ALIAS, EventTable

ACTIONS: dict[str, Callable[[Prepared], DataFrame]] = {}


def action(opcode: str):
    """Registers an action; a new one is a function from `Prepared` to a DataFrame."""

    def add(f: Callable[[Prepared], DataFrame]) -> Callable[[Prepared], DataFrame]:
        ACTIONS[opcode] = f
        return f

    return add


class Observer:
    """Sees each request before it is planned, and its result before anybody runs it.

    `after` may return the DataFrame with an `Observation` or a hint on it; what it returns is what the caller gets.
    """

    def before(self, request: dict) -> None: ...

    def after(self, request: dict, df: DataFrame) -> DataFrame | None: ...


class RowCounts(Observer):
    """Counts the rows of results as they are produced; `counts[k].get` waits for the k-th to be run."""

    def __init__(self) -> None:
        self.counts: list[Observation] = []

    def after(self, request: dict, df: DataFrame) -> DataFrame:
        self.counts.append(Observation())
        return df.observe(self.counts[-1], F.count(F.lit(1)).alias("rows"))


def run(table: EventTable, request: dict, observers: Sequence[Observer] = ()) -> DataFrame:
    """The DataFrame of a request; nothing is executed but what planning itself needs."""
    for o in observers:
        o.before(request)
    p = prepare(table, request)
    if request["opcode"] not in ACTIONS:
        raise RequestError([f"{request['opcode']} gives no single DataFrame"])
    df = ACTIONS[request["opcode"]](p)
    for o in observers:
        seen = o.after(request, df)
        df = df if seen is None else seen
    return df


def key_string(table: EventTable, path: str, c: Column) -> Column:
    kind = table.field_type(path)
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return c.cast("int").cast("string") if isinstance(kind, T.BooleanType) else c.cast("string")


def column_name(path: str) -> str:
    return path.replace(".", "_")


def _keys(p: Prepared, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with one `__key` column for each path, none of them null; arrays give a row for each element."""
    rows, names = p.rows, []
    for i, path in enumerate(paths):
        c = p.table.field(path)
        if isinstance(p.table.field_type(path), T.ArrayType):
            rows = rows.withColumn(f"__key{i}", F.explode(F.array_distinct(c)))
        else:
            rows = rows.withColumn(f"__key{i}", c)
        names.append(f"__key{i}")
    return rows.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names), F.lit(True))), names


def _named(p: Prepared, paths: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [key_string(p.table, path, F.col(n)).alias(column_name(path)) for path, n in zip(paths, names, strict=True)]


def _paths(request: dict) -> list[str]:
    return [x if isinstance(x, str) else x["field"] for x in request.get("nesting") or []]


def _numeric(table: EventTable, path: str) -> bool:
    return isinstance(table.field_type(path), T.NumericType)


@action("query")
def query(p: Prepared) -> DataFrame:
    """Documents in order of one field, ties by id. `after` takes the token of the last row seen."""
    sort = p.request.get("sort") or {"field": TIME_ALIAS, "order": "desc"}
    ascending = str(sort.get("order", "desc")).lower() == "asc"
    key, unique = p.table.field(sort["field"]), F.col(f"`{p.table.id}`")
    rows = p.rows
    if p.request.get("after") is not None:
        seen_key, seen_id = json.loads(base64.urlsafe_b64decode(p.request["after"]))
        kind = p.table.field_type(sort["field"])
        seen = F.lit(seen_key).cast(kind) if kind is not None else F.lit(None)
        tie = (unique > F.lit(seen_id)) if seen_key is None else (key == seen) & (unique > F.lit(seen_id))
        if seen_key is None:
            rows = rows.where(key.isNull() & tie)
        else:
            rows = rows.where(((key > seen) if ascending else (key < seen)) | key.isNull() | tie)
    rows = rows.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), unique.asc())
    start = int(p.request.get("from", 0))
    if start:
        rows = rows.offset(start)
    return rows.limit(int(p.request.get("limit", 10)))


def page_token(table: EventTable, request: dict, row) -> str:
    """The token that continues after `row`."""
    sort = (request.get("sort") or {"field": TIME_ALIAS})["field"]
    value = row[table.ts if sort.lower() == TIME_ALIAS else sort]
    return base64.urlsafe_b64encode(json.dumps([value if isinstance(value, int | float | type(None)) else str(value), row[table.id]]).encode()).decode()


def total_hits(table: EventTable, request: dict) -> DataFrame:
    return prepare(table, request).rows.agg(F.count("*").alias("total_hits"))


@action("count")
def count(p: Prepared) -> DataFrame:
    path = p.request.get("field")
    if not path:
        return p.rows.agg(F.count("*").alias("count"))
    if p.request.get("isDistinct") or p.request.get("distinct"):
        return p.rows.agg(metrics.cardinality(p.table.field(path), p.request.get("precision")).alias("count"))
    return p.rows.agg(F.count(p.table.field(path)).alias("count"))


@action("distinct")
def distinct(p: Prepared) -> DataFrame:
    """Distinct tuples, each column sorted by its own order."""
    nesting = p.request["nesting"]
    paths = _paths(p.request)
    rows, names = _keys(p, paths)
    rows = rows.select(*names).distinct()
    order = []
    for x, n in zip(nesting, names, strict=True):
        up = isinstance(x, str) or str(x.get("order", "asc")).lower() == "asc"
        order.append(F.col(n).asc() if up else F.col(n).desc())
    return rows.orderBy(*order).select(*_named(p, paths, names))


def _capped(df: DataFrame, names: Sequence[str], cap: int | None) -> DataFrame:
    """At most `cap` keys a level under each parent, the first in key order; no cap unless asked for."""
    if not cap:
        return df
    # The first level has no parent to part it by: its keys are taken from the distinct ones, in order.
    df = df.join(df.select(names[0]).distinct().orderBy(names[0]).limit(cap), names[0], "left_semi")
    for i, n in enumerate(names[1:], 1):
        level = Window.partitionBy(*names[:i]).orderBy(n)
        df = df.withColumn("__rank", F.dense_rank().over(level)).where(F.col("__rank") <= cap).drop("__rank")
    return df


@action("group")
def group(p: Prepared) -> DataFrame:
    """One row a tuple of keys, with the document count, a cardinality or one statistic."""
    paths = _paths(p.request)
    rows, names = _keys(p, paths)
    if p.request.get("uniqueCountOn"):
        value = metrics.cardinality(p.table.field(p.request["uniqueCountOn"]), p.request.get("precision")).alias("count")
    elif p.request.get("aggregationField"):
        path, kind = p.request["aggregationField"], p.request.get("aggregationType") or "count"
        value = (metrics.stat(kind, p.table.field(path)) if _numeric(p.table, path) or kind == "count" else metrics.cardinality(p.table.field(path))).alias(kind)
    else:
        value = F.count("*").alias("count")
    out = _capped(rows.groupBy(*names).agg(value), names, p.request.get("cap"))
    return out.select(*_named(p, paths, names), out.columns[-1])


#: Buckets in one array of a gap.
GAP_STEP = 86_400


def zero_filled(df: DataFrame, keys: Sequence[str], time: str, period: str, zone: str, values: dict[str, Column]) -> DataFrame:
    """`df` with a row for every bucket between the first and last of its group.

    What is filled is one row a bucket already, so groups are small; the range itself is made
    where the gap is, from each bucket to the next, and never gathered. A long gap is unfolded in
    two steps, so that no array has more than GAP_STEP buckets of a fixed size.
    """
    ahead = F.lead(time).over(Window.partitionBy(*keys).orderBy(time) if keys else Window.orderBy(time))
    rows = df.withColumn("__next", ahead)
    if period != "days":
        span = GAP_STEP * PERIOD_MS[period]
        rows = rows.withColumn("__from", F.explode(F.when(F.col("__next").isNull(), F.array(F.col(time))).otherwise(F.sequence(F.col(time), F.col("__next"), F.lit(span).cast("long")))))
        rows = rows.withColumn("__to", F.least(F.col("__next"), F.col("__from") + F.lit(span - PERIOD_MS[period]).cast("long")))
    else:
        rows = rows.withColumns({"__from": F.col(time), "__to": F.col("__next")})
    step = F.when(F.col("__next").isNull(), F.array(F.col(time))).otherwise(next_buckets(F.col("__from"), F.col("__to"), period, zone))
    rows = rows.withColumn("__at", F.explode(step)).where(F.col("__next").isNull() | (F.col("__at") != F.col("__next")))
    here = F.col("__at") == F.col(time)
    names = [c for c in df.columns if c not in (*keys, time)]
    return rows.select(*keys, F.col("__at").alias(time), *(F.when(here, F.col(c)).otherwise(values.get(c, F.lit(None))).alias(c) for c in names))


@action("histogram")
def histogram(p: Prepared) -> DataFrame:
    path, period = p.request.get("field") or TIME_ALIAS, p.request.get("period", "minutes")
    at = p.table.at(path)
    unique = p.request.get("uniqueCountOn")
    value = metrics.cardinality(p.table.field(unique), p.request.get("precision")) if unique else F.count("*")
    out = p.rows.where(at.isNotNull()).groupBy(bucket_start(at, period, p.table.zone).alias("period")).agg(value.alias("count"))
    return zero_filled(out, [], "period", period, p.table.zone, {"count": F.lit(0).cast("long")})


@action("trend")
def trend(p: Prepared) -> DataFrame:
    """Buckets of each term of a field."""
    path, period = p.request["field"], p.request.get("period", "days")
    at = p.table.at(p.request.get("timestamp") or TIME_ALIAS)
    unique = p.request.get("uniqueCountOn")
    value = metrics.cardinality(p.table.field(unique), p.request.get("precision")) if unique else F.count("*")
    rows, names = _keys(p, [path])
    out = rows.where(at.isNotNull()).groupBy(*names, bucket_start(at, period, p.table.zone).alias("period")).agg(value.alias("count"))
    out = zero_filled(out, names, "period", period, p.table.zone, {"count": F.lit(0).cast("long")})
    return out.select(*_named(p, [path], names), "period", "count")


def trend_pivot(p: Prepared, terms: Sequence[str] | None = None) -> DataFrame:
    """A row for each time, a column for each term; named terms save a pass over the data."""
    name = column_name(p.request["field"])
    return trend(p).groupBy("period").pivot(name, list(terms) if terms else None).agg(F.sum("count")).na.fill(0)


def _measures(p: Prepared, path: str) -> list[Column]:
    c = p.table.field(path)
    if not _numeric(p.table, path):
        return [F.count(c).alias("count")]
    out = metrics.stats(c, p.request.get("stats"))
    if "STATS_SKIP_PERCENTILES" not in (p.request.get("flags") or []):
        out += metrics.percentiles(c, p.request.get("percentiles"), p.request.get("accuracy"))
    return out


@action("stats")
def stats(p: Prepared) -> DataFrame:
    """The whole, and with nesting also each leaf group; `level` is 0 for the whole."""
    path, paths = p.request["field"], _paths(p.request)
    if not paths:
        return p.rows.agg(*_measures(p, path))
    whole = p.rows.agg(*_measures(p, path))
    rows, names = _keys(p, paths)
    leaves = rows.groupBy(*names).agg(*_measures(p, path))
    leaves = leaves.select(F.lit(1).alias("level"), *_named(p, paths, names), *leaves.columns[len(names) :])
    return whole.select(F.lit(0).alias("level"), *(F.lit(None).cast("string").alias(column_name(x)) for x in paths), "*").unionByName(leaves)


@action("statstrend")
def statstrend(p: Prepared) -> DataFrame:
    """Statistics of each bucket (of each leaf group); empty buckets have count 0 and sum 0."""
    path, paths, period = p.request["field"], _paths(p.request), p.request.get("period", "hours")
    at = p.table.at(p.request.get("timestamp") or TIME_ALIAS)
    rows, names = _keys(p, paths)
    out = rows.where(at.isNotNull()).groupBy(*names, bucket_start(at, period, p.table.zone).alias("period")).agg(*_measures(p, path))
    out = zero_filled(out, names, "period", period, p.table.zone, {"count": F.lit(0).cast("long"), "sum": F.lit(0.0), "sum_of_squares": F.lit(0.0)})
    return out.select(*_named(p, paths, names), *out.columns[len(names) :])


def multi_query(table: EventTable, request: dict, tables: dict[str, EventTable] | None = None) -> dict[str, DataFrame]:
    """The DataFrame of each named request; the outer filters hold for all of them."""
    prepare(table, request)  # checks
    outer = request.get("filters") or []
    found = {}
    for name, r in request["requests"].items():
        own = (tables or {}).get(r.get("table", ""), table)
        found[name] = run(own, {"now": request.get("now"), **r, "filters": [*(r.get("filters") or []), *outer]} if request.get("now") else {**r, "filters": [*(r.get("filters") or []), *outer]})
    return found


def windows_of(request: dict) -> list[tuple[int, int]]:
    """(low, high) of each window of a multi_time_query, latest first."""
    inner = request["actionRequest"]
    first = next(f for f in filters_of(inner) if f.operator == "between")
    skip = duration_ms(request["skipDuration"])
    samples = request.get("sampleSize")
    if not samples:
        samples = 30 // max(1, skip // DAY_MS) if skip > DAY_MS else 24 // max(1, skip // 3_600_000)
    return [(int(first.low) - k * skip, int(first.high) - k * skip) for k in range(max(1, int(samples)))]


def multi_time_query(table: EventTable, request: dict) -> DataFrame:
    """The same request over windows that step back in time; `window_start` names the window.

    The rows of all windows come from one scan: each row is given to the windows it lies in, and
    a count or group adds the window to its keys. Other actions are a union of one plan a window.
    """
    prepare(table, request)  # checks
    inner = request["actionRequest"]
    windows = windows_of(request)
    filters = filters_of(inner)
    first = next(f for f in filters if f.operator == "between")
    simple = inner["opcode"] in ("count", "group") and table.is_time(first.field) and not inner.get("isDistinct")
    if simple:
        rest = [f for f in inner["filters"] if f is not inner["filters"][filters.index(first)]]
        low, high = min(w[0] for w in windows), max(w[1] for w in windows)
        whole = {**inner, "filters": [*rest, {"operator": "between", "field": TIME_ALIAS, "temporal": True, "from": low, "to": high}]}
        p = prepare(table, whole)
        us = F.unix_micros(table.at())
        inside = F.array_compact(F.array(*(F.when(us.between(1000 * a, 1000 * b), F.lit(a).cast("long")) for a, b in windows)))
        rows = table.with_rows(p.rows.withColumn("window_start", F.explode(inside)))
        if inner["opcode"] == "count":
            path = inner.get("field")
            return rows.df.groupBy("window_start").agg((F.count(table.field(path)) if path else F.count("*")).alias("count"))
        keyed = run(rows, {**whole, "nesting": ["window_start", *inner["nesting"]]})
        return keyed.withColumn("window_start", F.col("window_start").cast("long"))
    out = []
    for a, b in windows:
        moved = [{**f, "from": a, "to": b} if f is inner["filters"][filters.index(first)] else f for f in inner["filters"]]
        out.append(run(table, {**inner, "filters": moved}).withColumn("window_start", F.lit(a).cast("long")))
    return reduce(lambda x, y: x.unionByName(y), out)


def arithmetic(text: str) -> tuple[Column, list[str]]:
    """A space-separated expression over series and numbers, and the series it names; a missing value counts as 0.

    What is divided by nothing is null. A text without an operator is the name of one series, spaces and all.
    """
    tokens = text.split()
    if not {"+", "-", "*", "/", "(", ")"} & set(tokens):
        tokens = [text]
    names, out, guarded = [], [], []
    for k, t in enumerate(tokens):
        divisor = k > 0 and tokens[k - 1] == "/"
        if t == "(":
            guarded.append(divisor)
            out.append("nullif((" if divisor else "(")
        elif t == ")":
            if not guarded:
                raise RequestError([f"ratio: {text}: a bracket is closed that was not opened"])
            out.append("), 0D)" if guarded.pop() else ")")
        elif t in ("+", "-", "*", "/"):
            out.append(t)
        else:
            number = len(tokens) > 1 and re.fullmatch(r"\d+(\.\d+)?", t)
            if not number:
                names.append(t)
            value = f"{t}D" if number else f"coalesce(cast(`{t.replace('`', '``')}` as double), 0D)"
            out.append(f"nullif({value}, 0D)" if divisor else value)
    if guarded:
        raise RequestError([f"ratio: {text}: a bracket is open"])
    return F.expr(" ".join(out)), list(dict.fromkeys(names))


def ratio(p: Prepared, numerator: str, denominator: str) -> DataFrame:
    """Percentage of one series of a trend in another, each a term or an expression over terms; 0 where there is nothing to divide by."""
    (up, above), (down, under) = arithmetic(numerator), arithmetic(denominator)
    wide = trend_pivot(p, list(dict.fromkeys([*above, *under])))
    value = F.coalesce(F.try_divide(up * 100.0, down), F.lit(0.0))
    return wide.select("period", value.alias("ratio"))


def gauge(p: Prepared, field: str, part: Sequence[str], whole: Sequence[str]) -> DataFrame:
    """Percentage of the documents with one set of values among those with another."""
    c = p.table.field(field)
    up, down = F.count(F.when(c.isin(list(part)), 1)), F.count(F.when(c.isin(list(whole)), 1))
    return p.rows.agg(F.coalesce(F.try_divide(up * 100.0, down), F.lit(0.0)).alias("percentage"))


def period_over_period(table: EventTable, request: dict, shift: str, series: int) -> DataFrame:
    """A histogram or trend of the present window and of those before, each moved by the real duration."""
    now = int(request["now"])
    out = []
    for k in range(series):
        at = now - k * duration_ms(shift)
        r = {**request, "now": at, "filters": [{**f, "currentTime": at} if f["operator"] == "last" else f for f in request.get("filters") or []]}
        out.append(run(table, r).withColumn("series", F.lit(k)))
    return reduce(lambda x, y: x.unionByName(y), out)


__all__ = ["ACTIONS", "Observer", "RequestError", "RowCounts", "action", "run"]
