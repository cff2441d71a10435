"""Field statistics, and an estimate of how many groups a request would make.

Statistics come from one aggregation over a day of events. The estimate needs no data.
It takes the rows that the filters are expected to let through as a random sample, and
asks how many values of each key such a sample shows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.filters import Filter
from tidemark.plans.requests import DAY_MS, prepare
from tidemark.sources.events import EventTable

#: Least number of rows to bother with, and most groups to allow.
LEAST_ROWS = 1000
MAX_GROUPS = 50_000
DECILES = tuple(range(10, 101, 10))
#: Days that a table without a ttl is expected to keep.
KEPT_DAYS = 30


@dataclass(frozen=True)
class FieldStats:
    """`kind` is fixed, cardinality, percentile or terms; `low` is the least value of a number."""

    kind: str
    count: int
    cardinality: int = 1
    deciles: tuple[float, ...] = ()
    terms: dict[str, int] = field(default_factory=dict)
    low: float | None = None


class TooManyGroups(ValueError):
    pass


def field_statistics(table: EventTable, paths: Sequence[str], exact: bool = True) -> DataFrame:
    """One row a field: count, cardinality, and of numbers deciles and least value.

    Approximate statistics are mergeable sketches in one global aggregate. Exact ones count each value first, in one
    pass for all fields, so that no task holds the distinct values of a field: its values are then ordered by a range
    shuffle, and the counts below each of its partitions say where a decile lies.
    """
    numeric = {p: isinstance(table.field_type(p), T.NumericType) for p in paths}
    if exact:
        return _exact_statistics(table, paths, numeric)
    shares = F.array(*(F.lit(d / 100) for d in DECILES))
    sizes, out = [], []
    for i, path in enumerate(paths):
        c = table.field(path)
        number = c.cast("double") if numeric[path] else F.lit(None).cast("double")
        sizes += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}"), F.percentile_approx(number, shares, 1000).alias(f"p{i}"), F.min(number).alias(f"m{i}")]
        out.append(F.struct(F.lit(path).alias("field"), F.col(f"n{i}").alias("count"), F.col(f"d{i}").alias("cardinality"), F.col(f"p{i}").alias("deciles"), F.col(f"m{i}").alias("low")))
    return table.df.agg(*sizes).select(F.explode(F.array(*out)).alias("s")).select("s.*")


def _exact_statistics(table: EventTable, paths: Sequence[str], numeric: dict[str, bool]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("field"), (table.field(p).cast("double") if numeric[p] else F.lit(None).cast("double")).alias("x"), table.field(p).cast("string").alias("v")) for p in paths)))
    values = table.df.select(each.alias("e")).select("e.*").where("v is not null").groupBy("field", "x", "v").agg(F.count("*").alias("n"))
    totals = values.groupBy("field").agg(F.sum("n").alias("count"), F.count("*").alias("cardinality"), F.min("x").alias("low"))
    numbers = values.where("x is not null").groupBy("field", "x").agg(F.sum("n").alias("n"))
    # Each partition of the range shuffle knows its own running counts; what lies below it is one row a partition.
    placed = numbers.repartitionByRange("field", "x").withColumn("part", F.spark_partition_id())
    below = placed.groupBy("field", "part").agg(F.sum("n").alias("size")).select(F.col("field"), F.col("part"), F.explode(F.sequence(F.col("part"), F.lit(_parts(placed) - 1))).alias("over"), "size")
    before = below.groupBy("field", F.col("over").alias("part")).agg(F.sum(F.when(F.col("over") > F.col("part"), F.col("size")).otherwise(0)).alias("before"))
    running = F.sum("n").over(_window("field", "part").orderBy("x"))
    ranked = placed.withColumn("end", running).join(before, ["field", "part"]).join(totals.select("field", "count"), "field")
    ranked = ranked.withColumns({"last": F.col("before") + F.col("end") - 1, "first": F.col("before") + F.col("end") - F.col("n")})
    # A decile lies between the values of two ranks; its place between them is the fraction of the rank.
    rank = F.transform(F.array(*(F.lit(d / 100) for d in DECILES)), lambda q: q * (F.col("count") - 1))
    wanted = ranked.select("field", "x", "first", "last", F.posexplode(rank).alias("d", "r"))
    hits = wanted.where(((F.floor("r") >= F.col("first")) & (F.floor("r") <= F.col("last"))) | ((F.ceil("r") >= F.col("first")) & (F.ceil("r") <= F.col("last"))))
    value = F.min("x") + (F.max("x") - F.min("x")) * (F.first("r") - F.floor(F.first("r")))
    deciles = hits.groupBy("field", "d").agg(value.alias("value")).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "value"))), lambda s: s["value"]).alias("deciles"))
    return totals.join(deciles, "field", "left").select("field", "count", "cardinality", "deciles", "low")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def term_histogram(table: EventTable, path: str) -> DataFrame:
    c = table.field(path)
    return table.df.where(c.isNotNull()).groupBy(c.cast("string").alias("term")).agg(F.count("*").alias("count"))


def wants_terms(count: int, cardinality: int, most: int) -> bool:
    """Whether a field is worth a histogram of its terms."""
    return cardinality <= 100 or (cardinality <= 5000 and count / max(cardinality, 1) > 100 and most / max(count, 1) < 100)


def day_of(table: EventTable, day: date) -> EventTable:
    """The rows of one day (UTC), the day that statistics are taken from; a stored table reads that folder only."""
    start = int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)
    inside = (table.field("_timestamp") >= table.time(start)) & (table.field("_timestamp") < table.time(start + DAY_MS))
    rows = table.df.where(F.col(table.date) == F.lit(day)) if table.date else table.df
    return table.with_rows(rows.where(inside))


def collect_statistics(table: EventTable, paths: Sequence[str], day: date | None = None) -> dict[str, FieldStats]:
    """Statistics for the estimate, of one day where it is named; what meets on the driver is bounded by the number of fields and 5000 terms each."""
    table = table if day is None else day_of(table, day)
    rows = field_statistics(table, paths, exact=False).collect()
    most = max((r["count"] for r in rows), default=0)
    out = {}
    for r in rows:
        kind, n, d = table.field_type(r["field"]), r["count"], r["cardinality"]
        if isinstance(kind, T.BooleanType):
            out[r["field"]] = FieldStats("fixed", n, 2)
        elif isinstance(kind, T.NumericType):
            out[r["field"]] = FieldStats("percentile", n, d, tuple(r["deciles"] or ()), low=r["low"])
        elif wants_terms(n, d, most):
            terms = {t["term"]: t["count"] for t in term_histogram(table, r["field"]).limit(5001).collect()}
            out[r["field"]] = FieldStats("terms", n, d, (), terms)
        else:
            out[r["field"]] = FieldStats("cardinality", n, d)
    return out


def below(x: float, s: FieldStats, with_equal: bool) -> float:
    """The share of a number's values below `x` (or up to it), on straight lines between its deciles."""
    points = [s.deciles[0] if s.low is None else s.low, *s.deciles]
    end = bisect_right(points, x) if with_equal else bisect_left(points, x)
    if end == 0 or end == len(points):
        return float(end > 0)
    a, b = points[end - 1], points[end]
    return (end - 1 + (x - a) / (b - a)) / (len(points) - 1)


def _one_value(v, s: FieldStats) -> float:
    """The share of rows with the value `v`."""
    if s.kind == "terms":
        return s.terms.get(str(v), 0) / max(1, sum(s.terms.values()))
    each = 1 / max(1, s.cardinality)
    if s.kind != "percentile" or not s.deciles:
        return each
    if not (s.deciles[0] if s.low is None else s.low) <= v <= s.deciles[-1]:
        return 0.0
    return max(each, below(v, s, True) - below(v, s, False))


def share(f: Filter, s: FieldStats) -> float:
    """The part of the rows that a filter is expected to let through, from 0 to 1; 1 where nothing is known."""
    numbers = s.kind == "percentile" and bool(s.deciles)
    match f.operator:
        case "equals" | "contains":
            part = _one_value(f.value, s)
        case "not_equals":
            part = 1 - _one_value(f.value, s)
        case "in":
            part = sum(_one_value(v, s) for v in set(f.values))
        case "not_in":
            part = 1 - sum(_one_value(v, s) for v in set(f.values))
        case "less_than" if numbers:
            part = below(f.value, s, False)
        case "less_equal" if numbers:
            part = below(f.value, s, True)
        case "greater_than" if numbers:
            part = 1 - below(f.value, s, True)
        case "greater_equal" if numbers:
            part = 1 - below(f.value, s, False)
        case "between" if numbers:
            part = below(f.high, s, True) - below(f.low, s, False)
        case _:
            part = 1.0
    return min(1.0, max(0.0, part))


def values_shown(s: FieldStats, rows: float, own: Sequence[Filter] = ()) -> float:
    """How many values of a field `rows` random rows are expected to show, if they pass the field's own filters."""
    part = math.prod(share(f, s) for f in own)
    if s.kind == "terms":
        total = max(1, sum(s.terms.values()))
        passed = [n for v, n in s.terms.items() if all(share(f, FieldStats("terms", n, 1, (), {v: n})) for f in own)]
        return max(1.0, sum(1 - math.exp(-rows * n / total / max(part, 1e-12)) for n in passed))
    values = max(1.0, s.cardinality * part)
    return max(1.0, values * (1 - math.exp(-rows / values)))


def estimated_groups(stats: dict[str, FieldStats], nesting: Sequence[str], filters: Sequence[Filter], days: float = 1, ttl_days: int | None = None) -> float:
    """How many groups the nesting is expected to make, never more than rows; 0 if too few rows are expected to matter."""
    rows = max((s.count for s in stats.values()), default=0) * min(days, ttl_days or KEPT_DAYS)
    rows *= math.prod(share(f, stats[f.field]) for f in filters if f.field in stats)
    if rows < LEAST_ROWS:
        return 0.0
    groups = math.prod(values_shown(stats[k], rows, [f for f in filters if f.field == k]) for k in nesting if k in stats)
    return min(groups, rows)


def check(table: EventTable, request: dict, stats: dict[str, FieldStats], most: int = MAX_GROUPS) -> None:
    """Raise if a group request is expected to make more than `most` groups."""
    p = prepare(table, request)
    low = high = None
    for f in p.filters:
        if table.is_time(f.field):
            a, b = f.bounds(p.now_ms)
            low = a if a is not None and (low is None or a > low) else low
            high = b if b is not None and (high is None or b < high) else high
    days = max(1.0, ((high if high is not None else p.now_ms) - (low or 0)) / DAY_MS)
    nesting = [x if isinstance(x, str) else x["field"] for x in request["nesting"]]
    n = estimated_groups(stats, nesting, p.filters, days, table.ttl_days)
    if n > most:
        raise TooManyGroups(f"about {n:.0f} groups expected, {most} allowed")
