"""The tables that are known: create, get, list and update, kept as entries of Spark's own catalog.

An entry is an external table of the catalog with the settings of the event table among its properties, so any
session with the same metastore finds it, and dropping one never deletes data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidemark.sources import store
from tidemark.sources.events import EventTable

_PROPERTY = "tidemark."


class TableError(ValueError):
    pass


@dataclass(frozen=True)
class TableInfo:
    name: str
    path: str
    ttl_days: int
    id: str = "id"
    ts: str = "ts"
    zone: str = "UTC"

    @property
    def key(self) -> str:
        return self.name.strip().lower()


def _checked(info: TableInfo) -> TableInfo:
    if not info.key or info.ttl_days <= 0:
        raise TableError(f"a table needs a name and a ttl of a day or more: {info.name!r}, {info.ttl_days}")
    return info


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _properties(info: TableInfo) -> str:
    return ", ".join(f"{_text(_PROPERTY + k)} = {_text(getattr(info, k))}" for k in ("path", "ttl_days", "id", "ts", "zone"))


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(_quoted(name.strip().lower()))


def create(spark: SparkSession, info: TableInfo, schema: str | None = None) -> None:
    """Adds a table; `schema` is the DDL of its columns, for readers that ask the catalog alone."""
    _checked(info)
    if exists(spark, info.key):
        raise TableError(f"{info.key} exists")
    columns = schema or f"{_quoted(info.id)} string, {_quoted(info.ts)} timestamp"
    spark.sql(f"create table {_quoted(info.key)} ({columns}) using parquet location {_text(info.path)} tblproperties ({_properties(info)})")


def get(spark: SparkSession, name: str) -> TableInfo:
    key = name.strip().lower()
    found = {}
    if exists(spark, key):
        rows = spark.sql(f"show tblproperties {_quoted(key)}").collect()
        found = {r.key.removeprefix(_PROPERTY): r.value for r in rows if r.key.startswith(_PROPERTY)}
    if not found:
        raise TableError(f"{key} is missing")
    return TableInfo(key, found["path"], int(found["ttl_days"]), found["id"], found["ts"], found["zone"])


def all_tables(spark: SparkSession) -> list[TableInfo]:
    """The event tables of the present database, by name; other tables and views are left out."""
    out = []
    for t in spark.catalog.listTables():
        if not t.isTemporary and t.tableType == "EXTERNAL":
            try:
                out.append(get(spark, t.name))
            except TableError:
                continue
    return sorted(out, key=lambda i: i.key)


def update(spark: SparkSession, info: TableInfo) -> None:
    """Sets a table's ttl and other settings; where the data lie can't change."""
    _checked(info)
    if get(spark, info.key).path != info.path:
        raise TableError(f"{info.key} lies elsewhere")
    spark.sql(f"alter table {_quoted(info.key)} set tblproperties ({_properties(info)})")


def opened(spark: SparkSession, name: str, **kw) -> EventTable:
    """The event table, with the ttl, zone and columns that the catalog names."""
    i = get(spark, name)
    return store.open_table(spark, i.path, i.key, id=i.id, ts=i.ts, ttl_days=i.ttl_days, zone=i.zone, **kw)
