"""The analytics over streams: event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import metrics
from tidemark.functions.filters import Filter, conjunction
from tidemark.sources.events import EventTable
from tidemark.sources.store import DATE

#: Widths of the bucket periods.
WIDTHS = {"seconds": "1 second", "minutes": "1 minute", "hours": "1 hour", "days": "1 day"}


def accepted_stream(table: EventTable, late: str = "1 hour", filters: Sequence[Filter] = (), now_ms: int = 0) -> DataFrame:
    """A stream of distinct documents: filtered, with a watermark, one row an id while the watermark lasts."""
    rows = table.df.where(conjunction(filters, table, now_ms)).withColumn(table.ts, F.col(table.ts).cast("timestamp"))
    return rows.withWatermark(table.ts, late).dropDuplicatesWithinWatermark([table.id])


def live_trend(table: EventTable, nesting: Sequence[str] = (), period: str = "minutes", late: str | None = "1 hour", field: str | None = None) -> DataFrame:
    """Counts (or statistics of `field`) of each bucket and group. A bucket is final when the watermark passes it.

    `late` is None for a stream that has its watermark already, such as `accepted_stream` gives.
    """
    rows = table.df.withColumn(table.ts, F.col(table.ts).cast("timestamp")).withWatermark(table.ts, late) if late else table.df
    keys = [table.field(x).cast("string").alias(x.replace(".", "_")) for x in nesting]
    measures = metrics.stats(table.field(field), ["count", "sum"]) if field else [F.count("*").alias("count")]
    out = rows.groupBy(F.window(table.ts, WIDTHS[period]), *keys).agg(*measures)
    return out.select(F.unix_millis("window.start").alias("period"), *out.columns[1:])


def ingest_stream(df: DataFrame, path: str, checkpoint: str, id: str = "id", ts: str = "ts", late: str = "1 day") -> StreamingQuery:
    """Append a stream to a table by day, once per id; documents of the far future are dropped."""
    rows = df.where(F.col(id).isNotNull() & (F.col(ts).cast("timestamp") <= F.current_timestamp() + F.expr("interval 1 day")))
    rows = rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([id]).withColumn(DATE, F.to_date(ts))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(DATE).outputMode("append").trigger(availableNow=True).start()
