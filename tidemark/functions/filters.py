"""The fifteen filters, as Columns. A list of filters is a conjunction."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeutil import window
from tidemark.sources.events import TIME_ALIAS, EventTable

#: Names of the filters, by what they need.
ONE_VALUE = ("equals", "not_equals", "greater_than", "greater_equal", "less_than", "less_equal", "contains", "wildcard")
MANY_VALUES = ("in", "not_in")
NO_VALUE = ("exists", "missing", "any")
RANGES = ("greater_than", "greater_equal", "less_than", "less_equal", "between")
OPERATORS = (*ONE_VALUE, *MANY_VALUES, *NO_VALUE, "between", "last")


@dataclass(frozen=True)
class Filter:
    operator: str
    field: str = ""
    value: Any = None
    values: tuple = ()
    low: Any = None
    high: Any = None
    temporal: bool = False
    duration: str | None = None
    now: int | None = None
    rounding: str = "none"

    @classmethod
    def of(cls, x: Filter | dict) -> Filter:
        if isinstance(x, Filter):
            return x
        op = x["operator"]
        name = x.get("field", TIME_ALIAS if op == "last" else "")
        return cls(op, name, x.get("value"), tuple(x.get("values", ())), x.get("from"), x.get("to"), bool(x.get("temporal", False)), x.get("duration"), x.get("currentTime"), str(x.get("roundingMode", "none")).lower())

    @property
    def is_temporal(self) -> bool:
        return self.operator == "last" or (self.temporal and self.operator in RANGES)

    def problems(self) -> list[str]:
        out = []
        if self.operator not in OPERATORS:
            return [f"unknown filter: {self.operator}"]
        if not self.field and self.operator != "any":
            out.append(f"{self.operator}: field is missing")
        if self.operator in ONE_VALUE and self.value is None:
            out.append(f"{self.operator}: value is missing")
        if self.operator in MANY_VALUES and not self.values:
            out.append(f"{self.operator}: values are missing")
        if self.operator == "between" and (self.low is None or self.high is None):
            out.append("between: from and to are needed")
        if self.operator == "last" and not self.duration:
            out.append("last: duration is missing")
        return out

    def bounds(self, now_ms: int) -> tuple[int | None, int | None]:
        """Lowest and highest epoch ms that a filter on time lets through; None where it is open."""
        if self.operator == "last":
            return window(self.duration, self.now if self.now is not None else now_ms, self.rounding)
        if self.operator == "between":
            return int(self.low), int(self.high)
        if self.operator in ("greater_than", "greater_equal"):
            return int(self.value), None
        if self.operator in ("less_than", "less_equal"):
            return None, int(self.value)
        return None, None


def _pattern(text: str) -> str:
    """A regular expression for `*` (any run) and `?` (one character)."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text) + r"\z"


#: Parts of a query string: a quoted phrase, or what stands between spaces.
_PART = re.compile(r'"([^"]*)"|(\S+)')


@dataclass(frozen=True)
class Term:
    text: str
    wild: bool
    negated: bool = False

    def test(self, c: Column) -> Column:
        return c.cast("string").rlike(_pattern(self.text)) if self.wild else c.cast("string") == self.text


def query_string(text: str) -> list[list[Term]]:
    """The alternatives of a `contains` value, each a list of terms that must all hold.

    AND binds closer than OR, NOT belongs to the term after it. What stands between these words is one term for the
    whole value of a field, with `*` and `?`; in quotes it is taken as written. A value of operators alone is a term.
    """
    groups: list[list[Term]] = [[]]
    words: list[str] = []
    quoted = negated = False

    def close() -> None:
        nonlocal words, quoted, negated
        if words:
            term = " ".join(words)
            groups[-1].append(Term(term, not quoted and bool(re.search(r"[*?]", term)), negated))
            words, quoted, negated = [], False, False

    for m in _PART.finditer(text):
        phrase, word = m.group(1), m.group(2)
        if phrase is None and word in ("AND", "OR", "NOT"):
            close()
            if word == "OR" and groups[-1]:
                groups.append([])
            negated = negated ^ (word == "NOT")
        else:
            if phrase is not None:
                close()
            words, quoted = [*words, word if phrase is None else phrase], phrase is not None
            if phrase is not None:
                close()
    close()
    groups = [g for g in groups if g]
    return groups or [[Term(text, False)]]


def column(f: Filter, table: EventTable, now_ms: int) -> Column:
    """`f` as a predicate. Negations keep rows without the field; on arrays, one matching element is enough."""
    if f.operator == "any":
        return F.lit(True)
    kind, c = table.field_type(f.field), table.field(f.field)
    if f.operator == "exists":
        return c.isNotNull()
    if f.operator == "missing":
        return c.isNull()
    if f.operator in ("not_equals", "not_in"):
        positive = Filter("equals" if f.operator == "not_equals" else "in", f.field, f.value, f.values)
        return ~F.coalesce(column(positive, table, now_ms), F.lit(False))
    if f.operator == "contains":
        held = lambda t: F.coalesce(F.exists(c, t.test) if isinstance(kind, T.ArrayType) else t.test(c), F.lit(False))
        every = ([~held(t) if t.negated else held(t) for t in g] for g in query_string(str(f.value)))
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in every))
    time = table.is_time(f.field) and not isinstance(kind, T.NumericType)
    json = kind is not None and f.field not in table.df.columns and "." in f.field and isinstance(kind, T.StringType)

    def literal(v: Any) -> Column:
        return table.time(v) if time and not isinstance(v, str) else F.lit(v)

    def test(x: Column) -> Column:
        def typed(v: Any) -> Column:  # fields in JSON strings take the type of what they are compared with
            if not json or isinstance(v, str):
                return x
            return x.try_cast("boolean" if isinstance(v, bool) else "double")

        match f.operator:
            case "equals":
                return typed(f.value) == literal(f.value)
            case "in":
                return typed(f.values[0]).isin([v if not time else literal(v) for v in f.values])
            case "greater_than":
                return typed(f.value) > literal(f.value)
            case "greater_equal":
                return typed(f.value) >= literal(f.value)
            case "less_than":
                return typed(f.value) < literal(f.value)
            case "less_equal":
                return typed(f.value) <= literal(f.value)
            case "between":
                return typed(f.low).between(literal(f.low), literal(f.high))
            case "last":
                low, high = f.bounds(now_ms)
                return x.between(literal(low), literal(high))
            case "wildcard":
                text = str(f.value)
                if re.search(r"[*?]", text):
                    return x.cast("string").rlike(_pattern(text + "*"))
                return x.cast("string").startswith(text)
        raise ValueError(f"unknown filter: {f.operator}")

    return F.exists(c, test) if isinstance(kind, T.ArrayType) else test(c)


def conjunction(filters: Sequence[Filter], table: EventTable, now_ms: int) -> Column:
    return reduce(lambda a, b: a & b, (column(f, table, now_ms) for f in filters), F.lit(True))


Predicate = Callable[[EventTable, int], Column]
