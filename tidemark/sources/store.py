"""Event tables on disk: ingest, routing, upsert, retention, compaction, lookups.

A table is a Parquet folder partitioned by event day. All changes are Spark writes; a
rewrite of some days uses dynamic partition overwrite, so other days are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.events import EventTable

DATE = "event_date"
DAY_MS = 86_400_000
MAX_TEXT = 1024
#: A step of ingest: a DataFrame of documents in, one out.
Mutator = Callable[[DataFrame], DataFrame]


def with_calendar(df: DataFrame, ts: str = "ts", zone: str = "UTC") -> DataFrame:
    """The calendar parts of the event time as a struct `date`."""
    at = F.col(ts).cast("timestamp")
    at = at if zone == "UTC" else F.from_utc_timestamp(at, zone)
    parts = {
        "year": F.year(at),
        "monthOfYear": F.month(at),
        "dayOfWeek": F.weekday(at) + 1,
        "dayOfMonth": F.dayofmonth(at),
        "hourOfDay": F.hour(at),
        "minuteOfHour": F.minute(at),
        "minuteOfDay": F.hour(at) * 60 + F.minute(at),
        "weekOfYear": F.weekofyear(at),
    }
    return df.withColumn("date", F.struct(*(c.alias(n) for n, c in parts.items())))


def rejected(df: DataFrame, id: str = "id", ts: str = "ts", data: Sequence[str] = ()) -> DataFrame:
    """The documents that can't be taken, with the reason."""
    reason = F.when(F.col(id).isNull() | (F.trim(F.col(id).cast("string")) == ""), "id is missing").when(F.col(ts).isNull(), "timestamp is missing")
    if data:
        reason = reason.when(F.coalesce(*(F.col(c).cast("string") for c in data)).isNull(), "data is missing")
    return df.withColumn("reason", reason).where("reason is not null")


def accepted(df: DataFrame, now_ms: int, id: str = "id", ts: str = "ts") -> DataFrame:
    """Documents with an id and a time no more than a day ahead."""
    ahead = F.timestamp_millis(F.lit(now_ms + DAY_MS))
    return df.where(F.col(id).isNotNull() & F.col(ts).isNotNull() & (F.col(ts).cast("timestamp") <= ahead))


def latest(df: DataFrame, id: str = "id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row an id, the last in `order`: an aggregate, so copies meet before the shuffle."""
    rest = [c for c in df.columns if c != id]
    best = F.max(F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order)))
    return df.groupBy(id).agg(best.alias("__r")).select(*(F.col(id) if c == id else F.col(f"__r.{c}").alias(c) for c in df.columns))


def upserted(old: DataFrame, new: DataFrame, id: str = "id", ts: str = "ts") -> DataFrame:
    """`old` with the rows of `new` in place of those with the same id."""
    return old.join(new.select(id).distinct(), id, "left_anti").unionByName(latest(new, id, (ts,)))


def raw_key_v1(table: str, id: Column) -> Column:
    """The older storage key `id:table`."""
    return F.concat_ws(":", id.cast("string"), F.lit(table))


#: Columns that ingest adds to a document.
METADATA = (DATE, "date", "metadata")


def translated_back(df: DataFrame, stored_id: str = "id", public_id: str = "metadata.id", ts: str = "ts") -> DataFrame:
    """Stored rows as the documents that came in: the public id again where one is kept, the calendar parts made anew from the time, other metadata gone."""
    kept = [c for c in df.columns if c not in METADATA and c != stored_id]
    has = public_id.split(".")[0] in df.columns
    back = F.coalesce(F.col(public_id).cast("string"), F.col(f"`{stored_id}`").cast("string")) if has else F.col(f"`{stored_id}`")
    return with_calendar(df.select(back.alias(stored_id), *(F.col(f"`{c}`") for c in kept)), ts)


def raw_key(table: str, id: Column, ts: Column, buckets: int = 32) -> Column:
    """A sortable storage key `bucket:table:time:id`; the bucket spreads writes."""
    bucket = F.lpad(F.pmod(F.xxhash64(id), F.lit(buckets)).cast("string"), 2, "0")
    return F.concat_ws(":", bucket, F.lit(table), F.lpad(F.unix_millis(ts.cast("timestamp")).cast("string"), 20, "0"), id.cast("string"))


def routed(df: DataFrame, table: str, routes: dict[str, str], type_field: str = "event_type", keep_source: bool = True) -> DataFrame:
    """`df` with the table that each document goes to; a routed document also stays in its source unless told otherwise."""
    target = F.lit(table)
    for kind, other in routes.items():
        target = F.when(F.col(type_field) == kind, F.lit(other)).otherwise(target)
    targets = F.array_distinct(F.array(F.lit(table), target)) if keep_source else F.array(target)
    return df.withColumn("table", F.explode(targets))


def without_large_text(df: DataFrame, size: int = MAX_TEXT, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Texts of `size` characters or more become null in what is queried (elements of arrays go); with `share` below 1, that part of the rows."""

    def cut(kind: T.DataType, c: Column, hit: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.when(~(hit & (F.length(c) >= size)) | c.isNull(), c)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.filter(c, lambda x: ~(hit & (F.coalesce(F.length(x), F.lit(0)) >= size)))
        if isinstance(kind, T.StructType):
            fields = [(f.name, cut(f.dataType, c[f.name], hit)) for f in kind.fields]
            if any(x is not None for _, x in fields):
                return F.when(c.isNotNull(), F.struct(*((c[n] if x is None else x).alias(n) for n, x in fields)))
        return None

    hit = F.lit(True) if share >= 1 else F.rand(seed) < share
    rows = df.withColumn("__hit", hit)
    out = []
    for f in df.schema.fields:
        new = cut(f.dataType, F.col(f"`{f.name}`"), F.col("__hit"))
        out.append(F.col(f"`{f.name}`") if new is None else new.alias(f.name))
    return rows.select(*out)


def ingest(df: DataFrame, path: str, now_ms: int, id: str = "id", ts: str = "ts", mutators: Sequence[Mutator] = (), file_rows: int = 5_000_000) -> None:
    """Append the accepted documents to the table at `path`, a folder for each event day of UTC.

    Rows of a day are dealt by id over as many tasks as a shuffle has, then written in files of `file_rows` rows at most.
    """
    df = accepted(df, now_ms, id, ts)
    for m in mutators:
        df = m(df)
    df = df.withColumn(DATE, utc_day(df, ts))
    # AQE joins the small parts of a day into few files and splits a day that holds most rows.
    df.hint("rebalance", DATE).write.partitionBy(DATE).option("maxRecordsPerFile", file_rows).mode("append").parquet(path)


def utc_day(df: DataFrame, ts: str) -> Column:
    """The day of the event time in UTC, whatever the session's zone; a time without a zone is taken as UTC."""
    kind, c = df.schema[ts].dataType, F.col(f"`{ts}`")
    if isinstance(kind, T.IntegralType):
        c = F.timestamp_millis(c)
    elif not isinstance(kind, T.TimestampType):
        return F.to_date(c)
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def open_table(spark: SparkSession, path: str, name: str, id: str = "id", ts: str = "ts", unique: bool = False, **kw) -> EventTable:
    """The stored table, with the columns of all its files. Of rows with one id the last counts, if `unique` asks for that.

    `unique` costs a shuffle of all that a request reads, and looks at the days that it reads: an id that moves to another day
    needs `upserted` at ingest.
    """
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if unique:
        rows = latest(rows, id, (ts,))
    return EventTable(rows, name=name.strip().lower(), id=id, ts=ts, date=DATE, **kw)


def by_id(table: EventTable, ids: Sequence) -> DataFrame:
    return table.df.where(F.col(table.id).isin(list(ids)))


def missing_ids(table: EventTable, ids: DataFrame) -> DataFrame:
    return ids.join(table.df.select(table.id), table.id, "left_anti")


def retained(table: EventTable, now_ms: int) -> DataFrame:
    """Rows of the days that the table's ttl keeps."""
    if not table.ttl_days:
        return table.df
    oldest = F.to_date(F.timestamp_millis(F.lit(now_ms - table.ttl_days * DAY_MS)))
    day = F.col(table.date) if table.date else F.to_date(F.col(table.ts))
    return table.df.where(day >= oldest)


def drop_expired(spark: SparkSession, path: str, today: date, ttl_days: int) -> int:
    """Delete the day folders that are older than the ttl; returns how many went."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith(f"{DATE}=") and name.split("=")[1] < str(today - timedelta(days=ttl_days)):
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def compact(spark: SparkSession, path: str, today: date, target_rows: int = 5_000_000) -> None:
    """Rewrite every day but today and tomorrow in files of about `target_rows` rows.

    A dynamic overwrite writes all days to a staging folder of its own and swaps each in as the job commits, so a run
    that is lost before leaves the table as it was, and another run does it all.
    """
    old = spark.read.parquet(path).where(F.col(DATE) < F.lit(today)).hint("rebalance", DATE)
    old.write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", target_rows).partitionBy(DATE).mode("overwrite").parquet(path)


def fields(table: EventTable) -> list[tuple[str, str]]:
    """(dotted path, type) of every leaf."""
    names = {T.StringType: "STRING", T.IntegerType: "INTEGER", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN", T.TimestampType: "DATE", T.TimestampNTZType: "DATE", T.DateType: "DATE"}

    def leaves(kind: T.DataType, path: str) -> list[tuple[str, str]]:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [(path, names.get(type(kind), "OBJECT"))]

    return sorted(leaves(table.df.schema, ""))


def latest_schema(days: Sequence[tuple[date, T.StructType]]) -> T.StructType:
    """One schema of several days': the newest day's type of a field wins."""
    out: dict[str, T.StructField] = {}
    for _, schema in sorted(days, key=lambda x: x[0], reverse=True):
        for f in schema.fields:
            out.setdefault(f.name, f)
    return T.StructType([out[n] for n in sorted(out)])
