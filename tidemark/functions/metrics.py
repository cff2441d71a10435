"""Statistics, percentiles and cardinalities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the statistics; the last three are computed only when asked for.
BASIC = ("count", "min", "max", "avg", "sum")
EXTENDED = ("sum_of_squares", "variance", "std_deviation")
PERCENTILES = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
#: Relative error of an approximate cardinality, by level; None is exact.
PRECISION = {"high": 0.01, "medium": 0.02, "low": 0.05, None: None}


def stat(name: str, c: Column) -> Column:
    match name:
        case "count":
            return F.count(c)
        case "min":
            return F.min(c)
        case "max":
            return F.max(c)
        case "avg":
            return F.avg(c)
        case "sum":
            return F.sum(c.cast("double"))
        case "sum_of_squares":
            return F.sum(c.cast("double") * c.cast("double"))
        case "variance":
            return F.var_pop(c)
        case "std_deviation":
            return F.stddev_pop(c)
    raise ValueError(f"unknown statistic: {name}")


def stat_names(asked: Sequence[str] | None) -> tuple[str, ...]:
    """All eight unless asked otherwise; one basic statistic alone, or the five basic ones."""
    if not asked or set(asked) & set(EXTENDED):
        return (*BASIC, *EXTENDED)
    return tuple(asked) if len(asked) == 1 else BASIC


def stats(c: Column, asked: Sequence[str] | None = None) -> list[Column]:
    return [stat(n, c).alias(n) for n in stat_names(asked)]


def percentile_name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def percentiles(c: Column, asked: Sequence[float] | None = None, accuracy: int | None = None) -> list[Column]:
    """All of a group's percentiles from one aggregate, whose elements Spark computes once.

    Exact (with interpolation) by default: a group's task holds its distinct values. `accuracy` asks for the mergeable
    sketch of fixed size that very large groups need.
    """
    points = list(asked or PERCENTILES)
    shares = F.array(*(F.lit(float(p) / 100) for p in points))
    every = F.percentile(c, shares) if accuracy is None else F.percentile_approx(c.cast("double"), shares, accuracy)
    return [every[k].cast("double").alias(percentile_name(p)) for k, p in enumerate(points)]


def cardinality(c: Column, precision: str | None = None) -> Column:
    error = PRECISION[precision]
    return F.count_distinct(c) if error is None else F.approx_count_distinct(c, error)
