"""Small results as nested documents, rows of text and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nested(df: DataFrame, keys: Sequence[str], value: str, limit: int = 50_000) -> dict:
    """A group result as nested dicts; more than `limit` rows are refused, as they meet on the driver."""
    rows = df.select(*keys, value).orderBy(*keys).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} groups; keep the DataFrame")
    out: dict = {}
    for row in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(row[k], {})
        at[row[keys[-1]]] = row[value]
    return out


def series(df: DataFrame, key: str | None = None, limit: int = 50_000) -> dict | list:
    """A trend as {term: [{period, count}]}, or a histogram as a list."""
    rows = df.orderBy(*([key] if key else []), "period").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} buckets; keep the DataFrame")
    if key is None:
        return [{"period": r["period"], "count": r["count"]} for r in rows]
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append({"period": r["period"], "count": r["count"]})
    return out


def flat(df: DataFrame) -> DataFrame:
    """Nested structs as columns named by dotted paths; arrays of structs merge into arrays of their fields."""

    def leaves(kind: T.DataType, path: list[str]) -> list[list[str]]:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(f.dataType, [*path, f.name])]
        return [path]

    return df.select(*(F.col(".".join(f"`{x}`" for x in path)).alias(".".join(path)) for path in leaves(df.schema, [])))


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, no quotes, nulls as empty fields; structs as dotted columns."""
    df = flat(df)
    text = [F.regexp_replace(F.col(f"`{c}`").cast("string"), '"', "").alias(c) for c in df.columns]
    df.select(*text).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def text_grid(df: DataFrame, rows: int = 1000) -> str:
    """A right-aligned grid of the first `rows` rows; a last line says so where there are more."""
    df = flat(df)
    found = [["" if v is None else str(v) for v in r] for r in df.limit(rows + 1).collect()]
    more = [f"(the first {rows} rows)"] if len(found) > rows else []
    found = found[:rows]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *found, strict=True)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda values: "|" + "|".join(f" {v:>{w}} " for v, w in zip(values, widths, strict=True)) + "|"
    return "\n".join([line, show(df.columns), line, *map(show, found), line, *more])
