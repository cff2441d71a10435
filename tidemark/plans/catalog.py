"""The registered queries: each request over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators.responses import flat
from tidemark.plans import guard
from tidemark.plans.requests import prepare
from tidemark.sources import store
from tidemark.sources.events import EventTable

NOW = 1706659200000  # 2024-01-31, just after the events end
DAY = 86_400_000
Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str, zone: str = "UTC") -> EventTable:
    """The events, with fields that are missing in some rows: `kind` is the type but for clicks, `amount` lacks every seventh user's."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.withColumns({"kind": F.when(F.col("event_type") != "click", F.col("event_type")), "amount": F.when(F.col("user_id") % 7 != 0, F.col("value"))})
    return EventTable(df, zone=zone)


EV = "(select *, nullif(event_type, 'click') as kind, case when user_id % 7 <> 0 then value end as amount from events) e"
PAST = f"epoch_us(ts) < {NOW}000"
DAY_BOUND = f"epoch_us(ts) between 1000 * ({NOW - DAY}) and 1000 * ({NOW})"


def lineitems(spark: SparkSession, sf_dir: str) -> EventTable:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return EventTable(df, name="lineitem", id="l_orderkey", ts="l_shipdate")


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def request(name: str, r: dict, sql: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, zone: str = "UTC") -> None:
    register(name, lambda spark, sf: shape(rounded(A.run(events(spark, sf, zone), {"now": NOW, **r}))), sql)


# Filters, as documents that pass them; the fields have nulls.
_IDS = lambda df: df.select("event_id", "event_type")
for _name, _filter, _where in [
    ("equals", {"operator": "equals", "field": "kind", "value": "view"}, "kind = 'view'"),
    ("not_equals", {"operator": "not_equals", "field": "kind", "value": "view"}, "kind is distinct from 'view'"),
    ("in", {"operator": "in", "field": "kind", "values": ["view", "error"]}, "kind in ('view', 'error')"),
    ("not_in", {"operator": "not_in", "field": "kind", "values": ["view", "error"]}, "(kind is null or kind not in ('view', 'error'))"),
    ("not_in_absent", {"operator": "not_in", "field": "nowhere", "values": ["x"]}, "true"),
    ("exists", {"operator": "exists", "field": "kind"}, "kind is not null"),
    ("missing", {"operator": "missing", "field": "kind"}, "kind is null"),
    ("any", {"operator": "any"}, "true"),
    ("greater_than", {"operator": "greater_than", "field": "amount", "value": 50}, "amount > 50"),
    ("greater_equal", {"operator": "greater_equal", "field": "user_id", "value": 50}, "user_id >= 50"),
    ("less_than", {"operator": "less_than", "field": "amount", "value": 50}, "amount < 50"),
    ("less_equal", {"operator": "less_equal", "field": "user_id", "value": 50}, "user_id <= 50"),
    ("between", {"operator": "between", "field": "amount", "from": 20, "to": 60}, "amount between 20 and 60"),
    ("last", {"operator": "last", "duration": "36h", "currentTime": NOW - 5 * DAY, "roundingMode": "floor"}, f"epoch_us(ts) between 1000 * ({NOW - 5 * DAY - 36 * 3600000}) and 1000 * ({NOW - 5 * DAY})"),
    ("contains", {"operator": "contains", "field": "kind", "value": "*ur?ha*"}, "kind like '%ur_ha%'"),
    ("contains_terms", {"operator": "contains", "field": "kind", "value": 'NOT view AND *r* OR "sig?up" OR signup'}, "((kind is distinct from 'view' and kind like '%r%') or kind = 'sig?up' or kind = 'signup')"),
    ("wildcard", {"operator": "wildcard", "field": "kind", "value": "s"}, "kind like 's%'"),
    ("json_path", {"operator": "greater_than", "field": "props.k", "value": 90}, "cast(props->>'$.k' as double) > 90"),
    ("time_between", {"operator": "between", "field": "_timestamp", "temporal": True, "from": NOW - 9 * DAY, "to": NOW - 7 * DAY}, f"epoch_us(ts) between 1000 * ({NOW - 9 * DAY}) and 1000 * ({NOW - 7 * DAY})"),
]:
    # A whole result, not a page: the filter alone, in the order of nothing.
    register(
        f"filter_{_name}",
        lambda spark, sf, f=_filter: _IDS(prepare(events(spark, sf), {"opcode": "query", "now": NOW, "filters": [f]}).rows),
        f"select event_id, event_type from {EV} where {_where} and {PAST}" if "last" not in _name and "time" not in _name else f"select event_id, event_type from {EV} where {_where}",
    )

_PAGE = lambda df: df.select("event_id", "user_id", "event_type")
request("query_sort_limit", {"opcode": "query", "sort": {"field": "value", "order": "asc"}, "limit": 25, "filters": [{"operator": "equals", "field": "event_type", "value": "purchase"}]}, f"select event_id, user_id, event_type from events where event_type = 'purchase' and {PAST} order by value, event_id limit 25", _PAGE)
request("query_pagination", {"opcode": "query", "from": 30, "limit": 15}, f"select event_id, user_id, event_type from events where {PAST} order by ts desc, event_id offset 30 limit 15", _PAGE)
request("query_nulls_last", {"opcode": "query", "sort": {"field": "kind", "order": "desc"}, "from": 5, "limit": 20}, f"select event_id, user_id, event_type from {EV} where {PAST} order by kind desc nulls last, event_id offset 5 limit 20", _PAGE)
request("query_json_field", {"opcode": "query", "limit": 10000, "filters": [{"operator": "greater_than", "field": "props.k", "value": 90}]}, f"select event_id, user_id, event_type from events where cast(props->>'$.k' as double) > 90 and {PAST} order by ts desc, event_id limit 10000", _PAGE)
register("query_total_hits", lambda s, d: A.total_hits(events(s, d), {"opcode": "query", "now": NOW, "filters": [{"operator": "exists", "field": "kind"}]}), f"select count(*) as total_hits from {EV} where kind is not null and {PAST}")


def _second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, r = events(spark, sf_dir), {"opcode": "query", "now": NOW, "sort": {"field": "user_id", "order": "asc"}, "limit": 12}
    last = A.run(table, r).collect()[-1]  # one page
    return _PAGE(A.run(table, {**r, "after": A.page_token(table, r, last)}))


register("query_scroll", _second_page, f"select event_id, user_id, event_type from events where {PAST} order by user_id, event_id offset 12 limit 12")

request("count_all", {"opcode": "count"}, f'select count(*) as "count" from events where {PAST}')
request("count_field", {"opcode": "count", "field": "kind"}, f'select count(kind) as "count" from {EV} where {PAST}')
request("count_distinct", {"opcode": "count", "field": "kind", "isDistinct": True}, f'select count(distinct kind) as "count" from {EV} where {PAST}')
request("distinct_one", {"opcode": "distinct", "nesting": [{"field": "kind", "order": "desc"}]}, f"select distinct kind from {EV} where kind is not null and {PAST}")
request("distinct_nested", {"opcode": "distinct", "nesting": [{"field": "kind"}, {"field": "user_id", "order": "desc"}]}, f"select distinct kind, cast(user_id as varchar) as user_id from {EV} where kind is not null and {PAST}")

request("group_count", {"opcode": "group", "nesting": ["kind"]}, f'select kind, count(*) as "count" from {EV} where kind is not null and {PAST} group by 1')
request("group_nested", {"opcode": "group", "nesting": ["kind", "user_id"], "filters": [{"operator": "greater_than", "field": "amount", "value": 10}]}, f'select kind, cast(user_id as varchar) as user_id, count(*) as "count" from {EV} where kind is not null and user_id is not null and amount > 10 and {PAST} group by 1, 2')
register("group_nested3", lambda s, d: A.run(lineitems(s, d), {"opcode": "group", "now": 2 * NOW, "nesting": ["l_returnflag", "l_linestatus", "l_linenumber"]}), 'select l_returnflag, l_linestatus, cast(l_linenumber as varchar) as l_linenumber, count(*) as "count" from lineitem group by 1, 2, 3')
request("group_unique", {"opcode": "group", "nesting": ["kind"], "uniqueCountOn": "user_id"}, f'select kind, count(distinct user_id) as "count" from {EV} where kind is not null and {PAST} group by 1')
for _stat, _call in {"min": "min(amount)", "max": "max(amount)", "avg": "avg(amount)", "sum": "sum(amount)", "count": "count(amount)", "sum_of_squares": "sum(amount * amount)", "variance": "var_pop(amount)", "std_deviation": "stddev_pop(amount)"}.items():
    _value = _call if _stat == "count" else f"round({_call}, 4)"
    request(f"group_{_stat}" if _stat != "count" else "group_field_count", {"opcode": "group", "nesting": ["kind"], "aggregationField": "amount", "aggregationType": _stat}, f'select kind, {_value} as "{_stat}" from {EV} where kind is not null and {PAST} group by 1')
request("group_text_field", {"opcode": "group", "nesting": ["event_type"], "aggregationField": "kind", "aggregationType": "max"}, f'select event_type, count(distinct kind) as "max" from {EV} where {PAST} group by 1')
request("group_cap", {"opcode": "group", "nesting": ["kind", "user_id"], "cap": 3}, f"""select kind, cast(user_id as varchar) as user_id, n as "count" from (select kind, user_id, count(*) as n, dense_rank() over (order by kind) as a, dense_rank() over (partition by kind order by user_id) as b from {EV} where kind is not null and {PAST} group by 1, 2) where a <= 3 and b <= 3""")


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = events(spark, sf_dir)
    table = table.with_rows(store.with_calendar(table.df))
    return A.run(table, {"opcode": "group", "now": NOW, "nesting": ["date.dayOfWeek", "date.hourOfDay"]})


register("group_date_part", _calendar, f'select cast(isodow(ts) as varchar) as "date_dayOfWeek", cast(hour(ts) as varchar) as "date_hourOfDay", count(*) as "count" from events where {PAST} group by 1, 2')
register(
    "calendar_parts",
    lambda s, d: flat(store.with_calendar(s.read.parquet(f"{d}/events.parquet")).select("event_id", *(F.col(f"date.{c}").cast("long").alias(c) for c in ("year", "monthOfYear", "dayOfWeek", "dayOfMonth", "hourOfDay", "minuteOfHour", "minuteOfDay", "weekOfYear")))),
    'select event_id, year(ts) as year, month(ts) as "monthOfYear", isodow(ts) as "dayOfWeek", day(ts) as "dayOfMonth", hour(ts) as "hourOfDay", minute(ts) as "minuteOfHour", hour(ts) * 60 + minute(ts) as "minuteOfDay", weekofyear(ts) as "weekOfYear" from events',
)


def _grid(period: str, value: str, where: str, keys: str = "", source: str = EV) -> str:
    """SQL of counts a bucket with the empty ones between a group's first and last."""
    unit = {"seconds": "second", "minutes": "minute", "hours": "hour", "days": "day"}[period]
    k, on = (f"{keys}, ", f"using ({keys}, t)") if keys else ("", "using (t)")
    group = f"group by {keys}" if keys else ""
    return f"""with f as (select {k}date_trunc('{unit}', ts) as t, {value} as n from {source} where {where} group by all),
        g as (select {k}unnest(generate_series(min(t), max(t), interval 1 {unit})) as t from f {group})
        select {k}epoch_ms(t) as period, coalesce(n, 0) as "count" from g left join f {on}"""


_WEEK = [{"operator": "between", "field": "_timestamp", "temporal": True, "from": NOW - 9 * DAY, "to": NOW - 2 * DAY}]
_WEEK_SQL = f"epoch_us(ts) between 1000 * ({NOW - 9 * DAY}) and 1000 * ({NOW - 2 * DAY})"
_HOUR = [{"operator": "between", "field": "_timestamp", "temporal": True, "from": NOW - 3 * DAY, "to": NOW - 3 * DAY + 7200000}]
request("histogram_seconds", {"opcode": "histogram", "period": "seconds", "filters": _HOUR}, _grid("seconds", "count(*)", f"epoch_us(ts) between 1000 * ({NOW - 3 * DAY}) and 1000 * ({NOW - 3 * DAY + 7200000})"))
request("histogram_minutes", {"opcode": "histogram", "period": "minutes", "now": NOW - 2 * DAY}, _grid("minutes", "count(*)", f"epoch_us(ts) between 1000 * ({NOW - 3 * DAY}) and 1000 * ({NOW - 2 * DAY})"))
request("histogram_hours", {"opcode": "histogram", "period": "hours", "filters": _WEEK}, _grid("hours", "count(*)", _WEEK_SQL))
request("histogram_days", {"opcode": "histogram", "period": "days", "filters": _WEEK}, _grid("days", "count(*)", _WEEK_SQL))
request("histogram_unique", {"opcode": "histogram", "period": "hours", "uniqueCountOn": "user_id", "filters": _WEEK}, _grid("hours", "count(distinct user_id)", _WEEK_SQL))
_IST = "(select * replace (ts + interval 330 minute as ts), ts as utc from events) e"
request("histogram_zone", {"opcode": "histogram", "period": "days", "filters": _WEEK}, f"with x as ({_grid('days', 'count(*)', _WEEK_SQL.replace('(ts)', '(utc)'), source=_IST)}) select period - 19800000 as period, \"count\" from x", zone="Asia/Kolkata")
request("trend_days", {"opcode": "trend", "field": "kind", "period": "days", "filters": _WEEK}, _grid("days", "count(*)", f"{_WEEK_SQL} and kind is not null", "kind"))
request("trend_values", {"opcode": "trend", "field": "kind", "period": "hours", "values": ["view", "error"], "filters": _WEEK}, _grid("hours", "count(*)", f"{_WEEK_SQL} and kind in ('view', 'error')", "kind"))
request("trend_unique", {"opcode": "trend", "field": "kind", "period": "days", "uniqueCountOn": "user_id", "filters": _WEEK}, _grid("days", "count(distinct user_id)", f"{_WEEK_SQL} and kind is not null", "kind"))
register("trend_pivot", lambda s, d: A.trend_pivot(prepare(events(s, d), {"opcode": "trend", "now": NOW, "field": "kind", "period": "days", "filters": _WEEK}), ["view", "error"]), f"""select epoch_ms(date_trunc('day', ts)) as period, count(*) filter (kind = 'view') as "view", count(*) filter (kind = 'error') as "error" from {EV} where kind is not null and {_WEEK_SQL} group by 1""")

_EIGHT = 'count(amount) as "count", round(min(amount), 4) as "min", round(max(amount), 4) as "max", round(avg(amount), 4) as "avg", round(sum(amount), 4) as "sum", round(sum(amount * amount), 4) as sum_of_squares, round(var_pop(amount), 4) as variance, round(stddev_pop(amount), 4) as std_deviation'
_SEVEN = ", ".join(f"round(quantile_cont(amount, {p / 100}), 4) as p{p}" for p in (1, 5, 25, 50, 75, 95, 99))
request("stats_root", {"opcode": "stats", "field": "amount", "flags": ["STATS_SKIP_PERCENTILES"]}, f"select {_EIGHT} from {EV} where {PAST}")
request("stats_percentiles", {"opcode": "stats", "field": "amount"}, f"select {_EIGHT}, {_SEVEN} from {EV} where {PAST}")
request("stats_text_field", {"opcode": "stats", "field": "kind"}, f'select count(kind) as "count" from {EV} where {PAST}')
request("stats_nested", {"opcode": "stats", "field": "amount", "nesting": ["kind"], "stats": ["count", "sum"], "percentiles": [50]}, f"""with e as (select * from {EV} where {PAST}), m as (select 0 as level, cast(null as varchar) as kind, count(amount) as "count", round(min(amount), 4) as "min", round(max(amount), 4) as "max", round(avg(amount), 4) as "avg", round(sum(amount), 4) as "sum", round(quantile_cont(amount, 0.5), 4) as p50 from e)
    select * from m union all select 1, kind, count(amount), round(min(amount), 4), round(max(amount), 4), round(avg(amount), 4), round(sum(amount), 4), round(quantile_cont(amount, 0.5), 4) from e where kind is not null group by kind""")
_STREND = """with f as (select {k}date_trunc('hour', ts) as t, count(amount) as n, min(amount) as a, max(amount) as b, avg(amount) as c, sum(amount) as s from {ev} where {w} group by all),
    g as (select {k}unnest(generate_series(min(t), max(t), interval 1 hour)) as t from f {g})
    select {k}epoch_ms(t) as period, coalesce(n, 0) as "count", round(a, 4) as "min", round(b, 4) as "max", round(c, 4) as "avg", round(case when n is null then 0.0 else s end, 4) as "sum" from g left join f using ({k}t)"""
_BASIC = {"stats": ["count", "min"], "flags": ["STATS_SKIP_PERCENTILES"], "field": "amount", "filters": _WEEK}
request("statstrend", {"opcode": "statstrend", **_BASIC}, _STREND.format(k="", ev=EV, w=_WEEK_SQL, g=""))
request("statstrend_nested", {"opcode": "statstrend", "nesting": ["kind"], **_BASIC}, _STREND.format(k="kind, ", ev=EV, w=f"{_WEEK_SQL} and kind is not null", g="group by kind"))
request("statstrend_percentiles", {"opcode": "statstrend", "period": "days", "field": "amount", "stats": ["count"], "percentiles": [50, 95], "filters": _WEEK}, f'select epoch_ms(date_trunc(\'day\', ts)) as period, count(amount) as "count", round(quantile_cont(amount, 0.5), 4) as p50, round(quantile_cont(amount, 0.95), 4) as p95 from {EV} where {_WEEK_SQL} group by 1')


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.multi_query(events(spark, sf_dir), {"opcode": "multi_query", "now": NOW, "filters": [{"operator": "equals", "field": "kind", "value": "view"}], "requests": {"all": {"opcode": "count"}, "users": {"opcode": "count", "field": "user_id", "isDistinct": True}, "kinds": {"opcode": "group", "nesting": ["kind"]}}})
    rows = [df.select(F.lit(n).alias("name"), F.col("count")) for n, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


register("multi_query", _multi, f"""with e as (select * from {EV} where kind = 'view' and {PAST}) select 'all' as name, count(*) as "count" from e union all select 'users', count(distinct user_id) from e union all select 'kinds', count(*) from e group by kind""")
_TIMES = {"opcode": "multi_time_query", "skipDuration": "1d", "sampleSize": 5, "actionRequest": {"opcode": "group", "nesting": ["kind"], "filters": _HOUR}}
_TIMES_SQL = f"(select {NOW - 3 * DAY} - k * {DAY} as a, {NOW - 3 * DAY + 7200000} - k * {DAY} as b from range(5) r(k)) w"
register("multi_time_query", lambda s, d: A.multi_time_query(events(s, d), {**_TIMES, "now": NOW}), f'select a as window_start, kind, count(*) as "count" from {EV} join {_TIMES_SQL} on epoch_us(ts) between 1000 * a and 1000 * b where kind is not null group by 1, 2')
register("multi_time_stats", lambda s, d: rounded(A.multi_time_query(events(s, d), {**_TIMES, "now": NOW, "actionRequest": {"opcode": "stats", "field": "amount", "stats": ["avg"], "flags": ["STATS_SKIP_PERCENTILES"], "filters": _HOUR}})), f'select a as window_start, round(avg(amount), 4) as "avg" from {_TIMES_SQL} left join {EV} on epoch_us(ts) between 1000 * a and 1000 * b group by 1')
register("ratio_trend", lambda s, d: rounded(A.ratio(prepare(events(s, d), {"opcode": "trend", "now": NOW, "field": "kind", "period": "days", "filters": _WEEK}), "error", "view")), f"select epoch_ms(date_trunc('day', ts)) as period, round(coalesce(count(*) filter (kind = 'error') * 100.0 / nullif(count(*) filter (kind = 'view'), 0), 0), 4) as ratio from {EV} where kind is not null and {_WEEK_SQL} group by 1")
register(
    "ratio_expression",
    lambda s, d: rounded(A.ratio(prepare(events(s, d), {"opcode": "trend", "now": NOW, "field": "kind", "period": "days", "filters": _WEEK}), "( error + 2 * purchase ) / signup", "view + error")),
    f"""with t as (select date_trunc('day', ts) as t, count(*) filter (kind = 'error') as e, count(*) filter (kind = 'purchase') as p, count(*) filter (kind = 'signup') as s, count(*) filter (kind = 'view') as v from {EV} where kind is not null and {_WEEK_SQL} group by 1)
        select epoch_ms(t) as period, round(coalesce((e + 2 * p) / nullif(s, 0) * 100.0 / nullif(v + e, 0), 0), 4) as ratio from t""",
)
register("percentage_gauge", lambda s, d: rounded(A.gauge(prepare(events(s, d), {"opcode": "count", "now": NOW}), "kind", ["error"], ["view", "error"])), f"select round(count(*) filter (kind = 'error') * 100.0 / count(*) filter (kind in ('view', 'error')), 4) as percentage from {EV} where {PAST}")
register("period_over_period", lambda s, d: A.period_over_period(events(s, d), {"opcode": "histogram", "now": NOW - DAY, "period": "hours"}, "1d", 3).withColumn("series", F.col("series").cast("long")), " union all ".join(f"select *, cast({k} as bigint) as series from ({_grid('hours', 'count(*)', f'epoch_us(ts) between 1000 * ({NOW - DAY - k * DAY - DAY}) and 1000 * ({NOW - DAY - k * DAY})')})" for k in range(3)))

_DECILES = ", ".join(f"quantile_cont({{c}}, {k / 10})" for k in range(1, 11))
register("field_stats_cardinality", lambda s, d: guard.field_statistics(events(s, d), ["kind", "user_id", "amount"]).select("field", "count", "cardinality"), f"""select 'kind' as field, count(kind) as "count", count(distinct kind) as cardinality from {EV} union all select 'user_id', count(user_id), count(distinct user_id) from {EV} union all select 'amount', count(amount), count(distinct amount) from {EV}""")
register("field_stats_deciles", lambda s, d: guard.field_statistics(events(s, d), ["user_id", "amount"]).select("field", *(F.round(F.col("deciles")[k], 4).alias(f"d{k}") for k in range(10))), " union all ".join(f"select '{c}' as field, " + ", ".join(f"round(quantile_cont(cast({c} as double), {k / 10}), 4) as d{k - 1}" for k in range(1, 11)) + f" from {EV}" for c in ("user_id", "amount")))
register("term_histogram", lambda s, d: guard.term_histogram(events(s, d), "kind"), f'select kind as term, count(*) as "count" from {EV} where kind is not null group by 1')
register("describe_table", lambda s, d: s.createDataFrame(store.fields(events(s, d)), "field string, type string"), "select * from (values ('amount', 'DOUBLE'), ('event_id', 'LONG'), ('event_type', 'STRING'), ('kind', 'STRING'), ('props', 'STRING'), ('ts', 'DATE'), ('user_id', 'LONG'), ('value', 'DOUBLE')) t(field, type)")

_CUT = NOW - 12 * DAY
register("ingest_future_drop", lambda s, d: store.accepted(s.read.parquet(f"{d}/events.parquet"), _CUT, "event_id").select("event_id"), f"select event_id from events where epoch_us(ts) <= {_CUT + DAY}000")
register("ingest_rejects", lambda s, d: store.rejected(events(s, d).df.withColumn("id", F.when(F.col("user_id") % 10 != 0, F.col("event_id"))), data=["kind"]).select("event_id", "reason"), f"select event_id, case when user_id % 10 = 0 then 'id is missing' else 'data is missing' end as reason from {EV} where user_id % 10 = 0 or kind is null")
register("upsert_latest", lambda s, d: store.latest(s.read.parquet(f"{d}/events.parquet"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type"), "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    new = df.where("user_id % 2 = 0").withColumn("event_type", F.lit("changed"))
    return store.upserted(df, new, "event_id").select("event_id", "event_type")


register("upsert_by_id", _upsert, "select event_id, case when user_id % 2 = 0 then 'changed' else event_type end as event_type from events")
register("route_by_type", lambda s, d: store.routed(s.read.parquet(f"{d}/events.parquet"), "events", {"error": "errors", "purchase": "sales"}).groupBy("table").agg(F.count("*").alias("count")), "select 'events' as \"table\", count(*) as \"count\" from events union all select 'errors', count(*) from events where event_type = 'error' union all select 'sales', count(*) from events where event_type = 'purchase'")
register("ttl_retained", lambda s, d: store.retained(EventTable(s.read.parquet(f"{d}/events.parquet"), ttl_days=7), NOW).select("event_id"), f"select event_id from events where cast(ts as date) >= cast(epoch_ms({NOW - 7 * DAY}) as date)")
register("raw_keys", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.substring(store.raw_key("events", F.col("event_id"), F.col("ts")), 4, 1000).alias("key")), "select event_id, 'events:' || lpad(cast(epoch_us(ts) // 1000 as varchar), 20, '0') || ':' || cast(event_id as varchar) as key from events")
register("text_remover", lambda s, d: store.without_large_text(s.read.parquet(f"{d}/documents.parquet"), 1024).select("doc_id", "text"), "select doc_id, case when length(text) < 1024 then text end as text from documents")
register("get_by_ids", lambda s, d: store.by_id(events(s, d), [1, 5, 77, 99999999]).select("event_id", "event_type"), "select event_id, event_type from events where event_id in (1, 5, 77, 99999999)")
register("missing_ids", lambda s, d: store.missing_ids(events(s, d), s.range(0, 200000, 500).select(F.col("id").alias("event_id"))), "select range as event_id from range(0, 200000, 500) where range not in (select event_id from events)")

# The SQL subset of the request language is Spark SQL over registered tables.
_TEXTS = {
    "sql_select": ("select event_id, user_id from events where event_type = 'view' and value between 10 and 60 and user_id in (1, 2, 3, 4, 5) order by event_id limit 20", None),
    "sql_distinct": ("select distinct event_type from events where event_type is not null", None),
    "sql_group": ("select event_type, count(*) as n, round(avg(value), 4) as a from events where event_type like '%r%' group by event_type", None),
    "sql_count_distinct": ("select count(distinct user_id) as n from events where not (event_type = 'view' or user_id > 100)", None),
    "sql_stats": ("select count(value) as n, round(sum(value), 4) as s, round(stddev_pop(value), 4) as sd, round(percentile(value, 0.95), 4) as p95 from events", "select count(value) as n, round(sum(value), 4) as s, round(stddev_pop(value), 4) as sd, round(quantile_cont(value, 0.95), 4) as p95 from events"),
    "sql_trend": ("select event_type, date_trunc('DAY', ts) as day, count(*) as n from events group by all", "select event_type, date_trunc('day', ts) as day, count(*) as n from events group by all"),
}


def sql(spark: SparkSession, text: str, tables: dict[str, EventTable]) -> DataFrame:
    """Spark SQL over event tables; `describe` and `show tables` work as they do in Spark."""
    for name, table in tables.items():
        table.df.createOrReplaceTempView(name)
    return spark.sql(text)


def _text(query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sql(spark, query, {"events": EventTable(spark.read.parquet(f"{sf_dir}/events.parquet"))})
        return df.withColumn("day", F.col("day").cast("timestamp_ntz")) if "day" in df.columns else df

    return run


for _name, (_spark_sql, _other) in _TEXTS.items():
    register(_name, _text(_spark_sql), _other or _spark_sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
