"""What several operators share: sources, checkpoints, keys.

A note on arrays that are costly to make: the operators unfold them with explode_outer and
drop the nulls above. A plain explode makes Spark infer a filter on the array's size below
the projection, which computes the array twice, and nested arrays many times.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACES = " \\t\\n\\x0B\\f\\r"
SPACE_CLASS = f"[{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Without one, a folder of this machine will do only where driver and executors are one process.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


#: Names of the tables behind the DataFrames that `stored` gave, and the open blocks of `work_tables`.
_NAMES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_BLOCKS: list[list[str]] = []
#: Lets Spark delete the shuffle files of a query when the query ends, not when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def collected(df: DataFrame) -> pa.Table:
    """The rows of `df`, of which there must be few whatever the input."""
    with _shuffles_deleted(df.sparkSession):
        return df.toArrow()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that its lineage ends there.

    It is a managed table of a database in that folder, with a name of its own. `dropped` deletes it; those that a
    lazy result still reads go at the end of the `work_tables` block around the operator, or with the folder.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/tables"
    database = f"work_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"create database if not exists {database} location '{folder}'")
    name = f"{database}.t_{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.format("parquet").options(**options).saveAsTable(name)
    for block in _BLOCKS[-1:]:
        block.append(name)
    out = spark.table(name)
    _NAMES[out] = name
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote; nothing that is still to run may read them."""
    for df in tables:
        df.sparkSession.sql(f"drop table if exists {_NAMES[df]}")


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """At the end of the block all tables go that `stored` wrote in it. Results must have been written by then."""
    own: list[str] = []
    _BLOCKS.append(own)
    try:
        yield
    finally:
        _BLOCKS.remove(own)
        for name in own:
            spark.sql(f"drop table if exists {name}")


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and `more`, and the whole row as one struct, out of the way of helper columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__whole")
    return docs.select("doc_id", "text", *more, whole)


def unpacked(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` again, with `text` and its length in place of the old ones."""
    columns = [F.col(f"__whole.`{c}`").alias(c) for c in docs.columns]
    columns[docs.columns.index("text")] = text.alias("text")
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*columns)


def normal_line(line: Column) -> Column:
    """Letters in lower case, each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " "))


def spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out fifth."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(5)


def bounded_sample(df: DataFrame, label: str, key: str, salts: int, per_salt: int) -> list[tuple]:
    """(label, key) of at most `salts * per_salt` rows a label, the same ones for the same rows.

    Rows are dealt to `salts` groups by a hash of the key, and each group gives its
    first rows by another hash, so no label's rows meet in one task. Labels must be
    few; of repeated keys one row counts.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(label, key).distinct()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(salts)))
    order = Window.partitionBy(label, "salt").orderBy(F.xxhash64(F.lit("order"), key), key)
    got = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_salt).collect()
    return sorted(((r[label], r[key]) for r in got), key=lambda x: (str(x[0]), x[1]))
