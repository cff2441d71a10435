"""Event tables: a DataFrame with an id, an event time and free fields."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name under which every table's event time can be addressed, in any case.
TIME_ALIAS = "_timestamp"


def _element(kind: T.DataType) -> T.DataType:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def _each(c: Column, name: str) -> Column:
    """A field of every struct of an array."""
    return F.transform(c, lambda x: x[name])


def _flat_array(c: Column, kind: T.ArrayType) -> Column:
    """Arrays of arrays as one array."""
    inner = kind.elementType
    while isinstance(inner, T.ArrayType):
        c, inner = F.flatten(c), inner.elementType
    return c


@dataclass(frozen=True)
class EventTable:
    """`date` names the partition column (a date), where the table is stored by day."""

    df: DataFrame
    name: str = "events"
    id: str = "event_id"
    ts: str = "ts"
    zone: str = "UTC"
    date: str | None = None
    ttl_days: int | None = None

    def with_rows(self, df: DataFrame) -> EventTable:
        return replace(self, df=df)

    def field_type(self, path: str) -> T.DataType | None:
        """Type of a dotted field, an array below an array of structs; None if the table has no such field, string below a JSON column."""
        if path.lower() == TIME_ALIAS:
            path = self.ts
        if path in self.df.columns:
            return self.df.schema[path].dataType
        kind: T.DataType = self.df.schema
        many = False
        for part in path.split("."):
            while isinstance(kind, T.ArrayType):
                kind, many = kind.elementType, True
            if isinstance(kind, T.StringType) and kind is not self.df.schema:
                kind = T.StringType()
                break
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
        while many and isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return T.ArrayType(kind) if many else kind

    def field(self, path: str) -> Column:
        """A field by dotted path; a missing one is null. Paths go on into JSON strings."""
        if path.lower() == TIME_ALIAS:
            return F.col(f"`{self.ts}`")
        if path in self.df.columns:
            return F.col(f"`{path}`")
        head, _, rest = path.partition(".")
        if head in self.df.columns and rest and isinstance(self.df.schema[head].dataType, T.StringType):
            return F.get_json_object(F.col(f"`{head}`"), f"$.{rest}")
        if self.field_type(path) is None:
            return F.lit(None)
        c, kind, many = F.col(f"`{head}`"), self.df.schema[head].dataType, False
        parts = rest.split(".")
        for i, part in enumerate(parts):
            if isinstance(kind, T.ArrayType):
                c, kind, many = _flat_array(c, kind), _element(kind), True
            if isinstance(kind, T.StringType):
                below = "$." + ".".join(parts[i:])
                return F.transform(c, lambda x: F.get_json_object(x, below)) if many else F.get_json_object(c, below)
            c, kind = (_each(c, part) if many else c[part]), kind[part].dataType
        if many and isinstance(kind, T.ArrayType):
            c = _flat_array(F.flatten(c), kind)
        # An object without the field has no value of it.
        return F.filter(c, lambda x: x.isNotNull()) if many else c

    def is_time(self, path: str) -> bool:
        return path.lower() == TIME_ALIAS or path == self.ts

    def time(self, ms: int) -> Column:
        """A literal of the event time's type."""
        kind = self.df.schema[self.ts].dataType
        if isinstance(kind, T.NumericType):
            return F.lit(int(ms))
        at = datetime.fromtimestamp(ms / 1000, UTC)
        return F.lit(at.replace(tzinfo=None)).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(at)

    def at(self, path: str = TIME_ALIAS) -> Column:
        """A field as a timestamp; whole numbers count milliseconds."""
        kind = self.field_type(path)
        c = self.field(path)
        return F.timestamp_millis(c) if isinstance(kind, T.IntegralType) else c.cast("timestamp")


def parquet_events(spark: SparkSession, path: str, **kw) -> EventTable:
    return EventTable(spark.read.parquet(path), **kw)


def json_events(spark: SparkSession, path: str, schema: str | T.StructType, **kw) -> EventTable:
    """Documents as JSON lines; the schema is given, as inference would read everything twice."""
    return EventTable(spark.read.schema(schema).json(path), **kw)
