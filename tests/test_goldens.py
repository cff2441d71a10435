"""Small hand-checked cases: filters, groups, buckets in a half-hour zone, statistics, batches."""

import pytest

from tidemark.functions import timeutil
from tidemark.operators import analytics as A
from tidemark.operators.responses import flat, nested, series, text_grid
from tidemark.plans.requests import RequestError, days_between, partition_days, prepare, problems, rewritten
from tidemark.sources.events import EventTable

SCHEMA = "id string, ts long, os string, version int, device string, battery int"
#: Rows of documents and, in the tests, what is known to be right for them.
T0 = 1397658117000
ROWS = [
    ("Z", T0, "android", 1, "nexus", 24),
    ("Y", 1397651117000, "android", 1, "nexus", 48),
    ("X", 1397651117000, "android", 3, "galaxy", 74),
    ("W", T0, "android", 2, "nexus", 99),
    ("A", 1397658118000, "android", 3, "nexus", 87),
    ("B", 1397658218001, "android", 2, "galaxy", 76),
    ("C", 1398658218002, "android", 2, "nexus", 78),
    ("D", 1397758218003, "ios", 1, "iphone", 24),
    ("E", 1397958118004, "ios", 2, "ipad", 56),
    ("F", 1398653118005, "ios", 2, "nexus", 35),
    ("G", 1398653118006, "ios", 2, "ipad", 44),
]
NOW = 1400000000000
ALL = [{"operator": "between", "field": "_timestamp", "temporal": True, "from": 0, "to": NOW}]


@pytest.fixture(scope="module")
def phones(spark):
    return EventTable(spark.createDataFrame(ROWS, SCHEMA), id="id", zone="Asia/Kolkata")


@pytest.fixture(scope="module")
def sparse(spark):
    rows = [("Z", 4, "android", "nexus", 24, None), ("Y", 3, "android", "nexus", 48, None), ("X", 2, "android", "nexus", 74, None), ("W", 1, "android", "nexus", 99, None)]
    rows += [("A", 1000, "android", "nexus", None, 1), ("B", 1001, "android", "galaxy", None, 1), ("C", 1002, "android", "nexus", None, 2), ("D", 1003, "ios", "iphone", None, 1), ("E", 1004, "ios", "ipad", None, 2)]
    return EventTable(spark.createDataFrame([(r[0], T0 + r[1], *r[2:]) for r in rows], "id string, ts long, os string, device string, battery int, version int"), id="id")


def run(table, opcode, **kw):
    return A.run(table, {"opcode": opcode, "now": NOW, **kw})


def ids(df):
    return [r.id for r in df.collect()]


def test_documents(sparse):
    q = lambda *f, **kw: ids(run(sparse, "query", filters=list(f), **kw))
    assert q({"operator": "not_in", "field": "device", "values": ["nexus", "galaxy"]}) == ["E", "D"]
    assert len(q({"operator": "not_in", "field": "absent", "values": ["x"]})) == 9
    assert q({"operator": "between", "field": "battery", "from": 47, "to": 75}) == ["Y", "X"]
    assert q({"operator": "contains", "field": "os", "value": "*droid*"}) == list("CBAZYXW")
    assert q({"operator": "equals", "field": "os", "value": "ios"}, **{"from": 1, "limit": 1}) == ["D"]
    assert q({"operator": "equals", "field": "os", "value": "android"}, {"operator": "greater_equal", "field": "battery", "value": 98}) == ["W"]
    assert q({"operator": "missing", "field": "battery"}, sort={"field": "_timestamp", "order": "asc"}) == list("ABCDE")
    assert len(q({"operator": "not_equals", "field": "battery", "value": 24})) == 8


def test_pages_by_token(sparse):
    seen, r = [], {"opcode": "query", "now": NOW, "limit": 4, "sort": {"field": "battery", "order": "asc"}}
    page = A.run(sparse, r).collect()
    while page:
        seen += [x.id for x in page]
        page = A.run(sparse, {**r, "after": A.page_token(sparse, r, page[-1])}).collect()
    assert seen == ["Z", "Y", "X", "W", "A", "B", "C", "D", "E"]


def test_groups(phones):
    g = lambda *n, **kw: run(phones, "group", nesting=list(n), **kw)
    assert nested(g("os"), ["os"], "count") == {"android": 7, "ios": 4}
    assert nested(g("os", filters=[{"operator": "equals", "field": "device", "value": "nexus"}]), ["os"], "count") == {"android": 5, "ios": 1}
    assert nested(g("os", "device"), ["os", "device"], "count") == {"android": {"nexus": 5, "galaxy": 2}, "ios": {"nexus": 1, "ipad": 2, "iphone": 1}}
    assert nested(g("os", "version", uniqueCountOn="device"), ["os", "version"], "count") == {"android": {"1": 1, "2": 2, "3": 2}, "ios": {"1": 1, "2": 2}}
    assert nested(g("os", "version", aggregationField="battery", aggregationType="max"), ["os", "version"], "max") == {"android": {"1": 48, "2": 99, "3": 87}, "ios": {"1": 24, "2": 56}}
    assert nested(g("os", "version", aggregationField="battery", aggregationType="sum"), ["os", "version"], "sum") == {"android": {"1": 72, "2": 253, "3": 161}, "ios": {"1": 24, "2": 135}}


def test_buckets_in_a_half_hour_zone(phones):
    full = lambda df: {r["period"]: r["count"] for r in series(df) if r["count"]}
    assert full(run(phones, "histogram", period="hours", filters=ALL)) == {1397647800000: 2, 1397655000000: 4, 1397755800000: 1, 1397957400000: 1, 1398652200000: 2, 1398655800000: 1}
    days = series(run(phones, "histogram", period="days", filters=ALL))
    assert {r["period"]: r["count"] for r in days if r["count"]} == {1397586600000: 6, 1397673000000: 1, 1397932200000: 1, 1398623400000: 3}
    assert [r["period"] for r in days] == list(range(1397586600000, 1398623400001, 86400000))
    trend = series(run(phones, "trend", field="os", filters=ALL), "os")
    assert {k: {r["period"]: r["count"] for r in v if r["count"]} for k, v in trend.items()} == {"android": {1397586600000: 6, 1398623400000: 1}, "ios": {1397673000000: 1, 1397932200000: 1, 1398623400000: 2}}


def test_counts_and_statistics(phones):
    value = lambda df: df.first()[0]
    assert value(run(phones, "count", field="os")) == 11
    assert value(run(phones, "count", field="os", isDistinct=True)) == 2
    assert [r.version for r in run(phones, "distinct", nesting=["version"]).collect()] == ["1", "2", "3"]
    row = run(phones, "stats", field="battery").first().asDict()
    assert row["count"] == 11 and row["sum"] == 645 and len(row) == 15
    assert list(run(phones, "stats", field="battery", stats=["max"], flags=["STATS_SKIP_PERCENTILES"]).first().asDict()) == ["max"]
    assert run(phones, "statstrend", field="battery", nesting=["os", "version"], period="days", filters=ALL).select("os", "version").distinct().count() == 5


def test_batches(sparse):
    found = A.multi_query(sparse, {"opcode": "multi_query", "now": NOW, "filters": [{"operator": "equals", "field": "os", "value": "ios"}], "requests": {"docs": {"opcode": "query"}, "n": {"opcode": "count"}}})
    assert ids(found["docs"]) == ["E", "D"] and found["n"].first()[0] == 2
    times = {"opcode": "multi_time_query", "skipDuration": "1d", "sampleSize": 1, "actionRequest": {"opcode": "count", "filters": [{"operator": "between", "field": "_timestamp", "temporal": True, "from": T0, "to": T0 + 2000}]}}
    assert [tuple(r) for r in A.multi_time_query(sparse, times).collect()] == [(T0, 9)]


def test_days_to_read(spark):
    table = EventTable(spark.createDataFrame([], "id string, ts long, event_date date"), id="id", zone="Asia/Kolkata", date="event_date")
    now = 1428151913000
    days = lambda f: [str(x) for x in partition_days(prepare(table, {"opcode": "count", "now": now, "filters": [f]}).filters, table, now)]
    assert days({"operator": "last", "duration": "10m"}) == ["2015-04-04", "2015-04-04"]
    assert days({"operator": "last", "duration": "2d"}) == ["2015-04-02", "2015-04-04"]
    assert days({"operator": "between", "field": "_timestamp", "temporal": True, "from": 1427997600000, "to": 1428001200000}) == ["2015-04-02", "2015-04-03"]
    assert [str(d) for d in days_between(1427997600000, now, "Asia/Kolkata")] == ["2015-04-02", "2015-04-03", "2015-04-04"]
    plan = prepare(table, {"opcode": "count", "now": now, "filters": [{"operator": "last", "duration": "1h"}]}).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "event_date" in plan


def test_what_is_refused(sparse):
    with pytest.raises(RequestError):
        A.run(sparse, {"opcode": "group", "nesting": []})
    assert problems({"opcode": "query", "limit": 20000})
    assert problems({"opcode": "count", "filters": [{"operator": "equals", "field": "", "value": None}]}) == ["equals: field is missing", "equals: value is missing"]
    assert problems({"opcode": "nothing"})
    assert rewritten(sparse, {"opcode": "histogram", "now": NOW})["filters"][0].operator == "last"


def test_durations():
    assert timeutil.duration_ms("30m") == 1_800_000 and timeutil.duration_ms("2 days") == 172_800_000 and timeutil.duration_ms("5ms") == 5
    assert timeutil.window("1h", 5_400_000, "floor") == (0, 5_400_000)
    assert timeutil.window("1h", 5_400_000, "ceiling") == (3_600_000, 5_400_000)
    assert [timeutil.bucket_size(x) for x in ("30m", "1d", "7d")] == ["minutes", "hours", "days"]
    with pytest.raises(ValueError):
        timeutil.duration_ms("soon")


def test_arrays_and_shapes(spark):
    df = spark.createDataFrame([(1, 1000, ["a", "b"], (5, ("x",))), (2, 2000, ["b"], (6, ("y",))), (3, 3000, None, None)], "id long, ts long, tags array<string>, s struct<n: int, t: struct<u: string>>")
    table = EventTable(df, id="id")
    assert sorted(r.id for r in run(table, "query", filters=[{"operator": "equals", "field": "tags", "value": "b"}]).collect()) == [1, 2]
    assert nested(run(table, "group", nesting=["tags"]), ["tags"], "count") == {"a": 1, "b": 2}
    assert nested(run(table, "group", nesting=["s.t.u"]), ["s_t_u"], "count") == {"x": 1, "y": 1}
    assert flat(df).columns == ["id", "ts", "tags", "s.n", "s.t.u"]
    assert text_grid(df.select("id")).splitlines()[1] == "| id |"
    assert text_grid(df.select("id"), 2).splitlines()[-1] == "(the first 2 rows)" and text_grid(df.select("id"), 3)[-1] == "+"


def test_query_strings(spark):
    df = spark.createDataFrame([(1, 1, "android", ["a", "b"]), (2, 2, "ios 12", ["b"]), (3, 3, None, None), (4, 4, "a*d\nx", [])], "id long, ts long, os string, tags array<string>")
    table = EventTable(df, id="id")
    got = lambda field, value: sorted(r.id for r in run(table, "query", now=10, filters=[{"operator": "contains", "field": field, "value": value}]).collect())
    assert got("os", "*droid*") == [1] and got("os", "android OR ios 12") == [1, 2] and got("os", "a* AND *d") == [1]
    assert got("os", "a*x") == [4] and got("os", '"a*d"') == [] and got("os", "android OR") == [1]
    assert got("os", "NOT android") == [2, 3, 4] and got("os", "NOT NOT android") == [1]
    assert got("tags", "a AND b") == [1] and got("tags", "b AND NOT a") == [2] and got("os", "OR") == []


def test_ratio_expressions(spark):
    df = spark.createDataFrame([(k, 1000 * k, t) for k, t in enumerate("aaab")], "id long, ts long, kind string")
    p = A.prepare(EventTable(df, id="id"), {"opcode": "trend", "now": 10_000, "field": "kind", "period": "days"})
    share = lambda up, down: A.ratio(p, up, down).first().ratio
    assert share("b", "a + b") == 25.0 and share("a", "b - b") == 0.0 and share("( a - 1 ) / ( b + 1 )", "2 * b") == 50.0 and share("a / c", "b") == 0.0
    for bad in ("( a + b", "a + b )"):
        with pytest.raises(RequestError):
            A.arithmetic(bad)


def test_observers(sparse):
    class Names(A.Observer):
        seen = []

        def before(self, request):
            self.seen.append(request["opcode"])

    counts = A.RowCounts()
    df = A.run(sparse, {"opcode": "query", "now": NOW, "limit": 3}, [Names(), counts])
    assert Names.seen == ["query"] and len(df.collect()) == counts.counts[0].get["rows"]
    with pytest.raises(RequestError):
        A.run(sparse, {"opcode": "query", "limit": 0}, [Names()])
    assert Names.seen == ["query", "query"]


def test_long_gaps_are_filled(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.analytics import zero_filled

    rows = spark.createDataFrame([(0, 5), (86_400_000, 6), (1_500_000_000, 7)], "period long, count long")
    got = zero_filled(rows, [], "period", "seconds", "UTC", {"count": F.lit(0).cast("long")})
    r = got.agg(F.count("*").alias("n"), F.countDistinct("period").alias("d"), F.sum("count").alias("s"), F.max("period").alias("m")).first()
    assert (r.n, r.d, r.s, r.m) == (1_500_001, 1_500_001, 18, 1_500_000_000)
