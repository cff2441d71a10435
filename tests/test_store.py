"""Tables on disk, field statistics and the guard, streams."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions.filters import Filter
from tidemark.operators.analytics import run
from tidemark.operators.responses import write_csv
from tidemark.plans import guard
from tidemark.plans.guard import FieldStats
from tidemark.sources import store, tables
from tidemark.sources.events import EventTable, json_events
from tidemark.streaming.live import accepted_stream, ingest_stream, live_trend

DAY = 86_400_000
NOW = 1704499200000  # 2024-01-06


@pytest.fixture
def some(spark):
    rows = [(k, NOW - (k % 4) * DAY - 1000, "a" if k % 3 else "b", float(k)) for k in range(40)] + [(100, NOW + 5 * DAY, "a", 0.0), (None, NOW, "a", 0.0)]
    return spark.createDataFrame(rows, "id long, ms long, kind string, value double").select("id", F.timestamp_millis("ms").alias("ts"), "kind", "value")


def test_ingest_by_day(spark, some, tmp_path):
    path = str(tmp_path / "t")
    store.ingest(some, path, NOW, mutators=[lambda df: df.withColumn("extra", F.lit(1))])
    table = store.open_table(spark, path, " Events ", ttl_days=2)
    assert table.name == "events" and table.df.count() == 40 and table.df.select(store.DATE).distinct().count() == 4
    assert store.retained(table, NOW).count() == 20
    store.compact(spark, path, date(2024, 1, 5))
    assert spark.read.parquet(path).count() == 40
    assert store.drop_expired(spark, path, date(2024, 1, 6), 2) == 2
    assert spark.read.parquet(path).count() == 20
    assert sorted(r.id for r in store.missing_ids(store.open_table(spark, path, "t"), spark.createDataFrame([(0,), (100,)], "id long")).collect()) == [100]


def test_rejects_and_upserts(spark, some):
    assert [r.reason for r in store.rejected(some).collect()] == ["id is missing"]
    new = spark.createDataFrame([(1, "x"), (1, "y")], "id long, kind string").select("id", F.timestamp_millis(F.lit(NOW) + F.when(F.col("kind") == "y", 1).otherwise(0)).alias("ts"), "kind", F.lit(0.0).alias("value"))
    got = store.upserted(some.where("id is not null"), new).where("id = 1").collect()
    assert [r.kind for r in got] == ["y"]


def test_large_text(spark):
    df = spark.createDataFrame([(1, "x" * 20, ["short", "y" * 20], ("z" * 20, 3)), (2, None, None, None)], "id int, t string, a array<string>, s struct<u: string, n: int>")
    got = store.without_large_text(df, 10).orderBy("id").collect()
    assert got[0].t is None and got[0].a == ["short"] and got[0].s.u is None and got[0].s.n == 3 and got[1].a is None and got[1].s is None
    assert store.without_large_text(df, 10, share=0.0).first().t == "x" * 20


def test_schema(spark):
    df = spark.createDataFrame([], "w string, d struct<x: int>, h array<struct<y: string>>")
    assert store.fields(EventTable(df)) == [("d.x", "INTEGER"), ("h.y", "STRING"), ("w", "STRING")]
    old, new = spark.createDataFrame([], "version int, a long").schema, spark.createDataFrame([], "version string").schema
    assert store.latest_schema([(date(2024, 1, 1), old), (date(2024, 1, 2), new)]).simpleString() == "struct<a:bigint,version:string>"


def test_guard(spark):
    df = spark.range(4000).select(F.col("id"), (F.lit(NOW) - F.col("id")).alias("ts"), F.col("id").cast("string").alias("device"), F.when(F.col("id") % 4 == 0, "ios").otherwise("android").alias("os"), (F.col("id") % 101).cast("int").alias("value"), (F.col("id") % 2 == 0).alias("on"))
    table = EventTable(df, id="id")
    stats = guard.collect_statistics(table, ["device", "os", "value", "on"])
    assert {k: s.kind for k, s in stats.items()} == {"device": "cardinality", "os": "terms", "value": "percentile", "on": "fixed"}
    day = [{"operator": "last", "duration": "1d"}]
    guard.check(table, {"opcode": "group", "nesting": ["os"], "filters": day, "now": NOW}, stats)
    with pytest.raises(guard.TooManyGroups):
        guard.check(table, {"opcode": "group", "nesting": ["os", "device"], "filters": day, "now": NOW}, stats, most=1000)
    guard.check(table, {"opcode": "group", "nesting": ["os", "device"], "filters": [*day, {"operator": "less_than", "field": "value", "value": 15}], "now": NOW}, stats, most=1000)
    terms = FieldStats("terms", 100, 2, (), {"a": 75, "b": 25})
    assert guard.share(Filter("equals", "x", "b"), terms) == 0.25 and guard.share(Filter("not_in", "x", values=("a",)), terms) == 0.25
    ten = FieldStats("percentile", 100, 100, tuple(range(10, 101, 10)))
    assert guard.share(Filter("between", "x", low=20, high=40), ten) == pytest.approx(0.2) and guard.share(Filter("greater_than", "x", 85), ten) == pytest.approx(0.15)
    for f in (Filter("greater_than", "x", 1000), Filter("less_than", "x", -5), Filter("equals", "x", 400)):
        assert guard.share(f, ten) == 0
    up = [guard.share(Filter("less_equal", "x", v), ten) for v in range(0, 120, 7)]
    assert up == sorted(up) and up[0] == 0 and up[-1] == 1
    assert guard.values_shown(FieldStats("cardinality", 10, 10**6), 1000) <= 1000 and guard.estimated_groups({"x": FieldStats("cardinality", 5000, 10**9)}, ["x"], []) <= 5000


def test_days_of_a_stored_table_in_other_zones(spark, tmp_path):
    """Rows around midnight of three zones, written in a session of another zone, are all found."""
    path, edge = str(tmp_path / "z"), 1704412800000  # 2024-01-05 in UTC
    rows = spark.range(-30, 31).select(F.col("id"), F.timestamp_millis(F.lit(edge) + F.col("id") * 3_600_000).alias("ts"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        store.ingest(rows, path, NOW)
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            table = store.open_table(spark, path, "z", zone=zone)
            got = run(table, {"opcode": "count", "now": NOW, "filters": [{"operator": "between", "field": "_timestamp", "temporal": True, "from": edge - 15 * 3_600_000, "to": edge + 15 * 3_600_000}]})
            assert got.first()["count"] == 31
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {str(r[0]) for r in spark.read.parquet(path).select(store.DATE).distinct().collect()} == {"2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06"}


def test_fields_below_arrays(spark):
    df = spark.createDataFrame([(1, NOW, [("a", 1), ("b", None)]), (2, NOW, [("b", 3)]), (3, NOW, None), (4, NOW, [])], "event_id long, ts long, items array<struct<name: string, n: int>>")
    table = EventTable(df)
    ids = lambda f: sorted(r.event_id for r in run(table, {"opcode": "query", "now": NOW + 1, "filters": [f]}).collect())
    assert ids({"operator": "equals", "field": "items.name", "value": "b"}) == [1, 2]
    assert ids({"operator": "not_equals", "field": "items.name", "value": "a"}) == [2, 3, 4]
    assert ids({"operator": "greater_than", "field": "items.n", "value": 2}) == [2]
    got = {r.items_name: r["count"] for r in run(table, {"opcode": "group", "now": NOW + 1, "nesting": ["items.name"]}).collect()}
    assert got == {"a": 1, "b": 2}


def test_documents_back(spark, some):
    back = store.translated_back(some.where("id is not null").withColumn("metadata", F.struct(F.concat(F.lit("p"), "id").alias("id"))).withColumn(store.DATE, F.to_date("ts")))
    assert back.columns == ["id", "ts", "kind", "value", "date"] and back.orderBy("ts").first().id.startswith("p")
    assert spark.range(1).select(store.raw_key_v1("t", F.col("id")).alias("k")).first().k == "0:t"


def test_tables(spark, some, tmp_path):
    info = tables.TableInfo(" Clicks_1 ", str(tmp_path / "it's"), 2)
    tables.create(spark, info)
    try:
        store.ingest(some, info.path, NOW)
        assert tables.get(spark, "clicks_1").ttl_days == 2 and [i.key for i in tables.all_tables(spark)] == ["clicks_1"]
        assert store.retained(tables.opened(spark, "CLICKS_1"), NOW).count() == 20
        tables.update(spark, replace(info, ttl_days=9))
        assert tables.opened(spark, "clicks_1").ttl_days == 9
        for wrong in (lambda: tables.create(spark, info), lambda: tables.update(spark, replace(info, path="/x")), lambda: tables.get(spark, "none"), lambda: tables.create(spark, replace(info, name=" ")), lambda: tables.update(spark, replace(info, ttl_days=0))):
            with pytest.raises(tables.TableError):
                wrong()
    finally:
        spark.sql("drop table clicks_1")
    assert spark.read.parquet(info.path).count() == 40


def test_csv(spark, tmp_path):
    write_csv(spark.createDataFrame([('a"b', None, (1,))], "x string, y string, z struct<k: int>"), str(tmp_path / "c"))
    lines = {line for p in (tmp_path / "c").glob("*.csv") for line in p.read_text().splitlines()}  # each file has the header
    assert lines == {"x,y,z.k", "ab,,1"}


def test_streams(spark, some, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    clean = some.where("id is not null")
    clean.unionAll(clean).write.parquet(source)
    live = spark.readStream.schema(clean.schema).parquet(source)
    ingest_stream(live, out, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(out).count() == 41
    table = EventTable(live, id="id")
    q = live_trend(EventTable(accepted_stream(table, "10 days"), id="id"), ["kind"], "days", None).writeStream.format("memory").queryName("trend").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    json_events(spark, source, "id long")
    assert spark.table("trend").columns == ["period", "kind", "count"]
