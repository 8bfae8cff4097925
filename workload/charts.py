"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.operators import charts, impute, outliers

from .registry import query, sql_skew

c = F.col

_ALL = ("event_id", "ts", "user_id", "event_type", "value")
_BOUNDS = """
    q as (select quantile_cont(value, 0.25) as q1, median(value) as q2, quantile_cont(value, 0.75) as q3 from dirty_events),
    bounds as (select q1, q2, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)"""


def _after(t):
    """The table with outliers limited and nulls filled with the median."""
    df = t.dirty_events
    return impute.impute(outliers.treat_outliers(df, ["value"], action="clip"), ["value"], "median")


_AFTER = f"""
    with {_BOUNDS},
    clipped as (select event_id, ts, user_id, event_type, case when value is not null then greatest(least(value, hi), lo) end as value from dirty_events, bounds),
    after as (select event_id, ts, user_id, event_type, coalesce(value, (select median(value) from clipped)) as value from clipped)"""


@query("null_ranking", " union all ".join(f"""
    select '{n}' as "column", count(*) - count({n}) as nulls, round_even((count(*) - count({n})) * 100.0 / count(*), 2) as null_pct
    from dirty_events having count(*) > count({n})""" for n in _ALL))
def _(t):
    return charts.null_ranking(t.dirty_events)


@query("null_comparison", _AFTER + """
    select 'event_type' as "column", count(*) - count(event_type) as before, (select count(*) - count(event_type) from after) as after from dirty_events
    union all select 'value', count(*) - count(value), (select count(*) - count(value) from after) from dirty_events""")
def _(t):
    return charts.null_comparison(t.dirty_events, _after(t))


def _histogram_sql(values, bins=30):
    return f"""
    v as ({values}), e as (select min(x) as a, max(x) as b, (max(x) - min(x)) / {bins} as w from v),
    edges as (select cast(i as integer) as bin, a + i * w as start, case when i = {bins - 1} then b else a + (i + 1) * w end as "end" from e, range({bins}) r(i))
    select bin, round(start, 6) as start, round("end", 6) as "end",
      (select count(*) from v where x >= start and (x < "end" or bin = {bins - 1})) as rows from edges"""


@query("histogram", "with " + _histogram_sql("select value as x from dirty_events where value is not null"))
def _(t):
    return charts.histogram(t.dirty_events, "value")


@query("histogram_lineitem", "with " + _histogram_sql("select l_quantity as x from lineitem"))
def _(t):
    return charts.histogram(t.lineitem, "l_quantity")


@query("distribution_histogram", f"with {_BOUNDS}, " + _histogram_sql("select value as x from dirty_events, bounds where value between lo and hi"))
def _(t):
    return charts.distribution_histogram(t.dirty_events, "value")


@query("card_histogram", f"""
    with {_BOUNDS}, e as (select min(value) as a, max(value) as b, (max(value) - min(value)) / 14 as w from dirty_events),
    edges as (select cast(i as integer) as bin, case when i = 0 then a - (b - a) * 0.001 else a + i * w end as start,
      case when i = 13 then b else a + (i + 1) * w end as "end" from e, range(14) r(i)),
    counted as (select bin, start, "end", (select count(*) from dirty_events where value > start and value <= "end") as rows from edges)
    select bin, round(start, 6) as start, round("end", 6) as "end", rows,
      rows > 0 and ((start + "end") / 2 < lo or (start + "end") / 2 > hi) as outside from counted, bounds""")
def _(t):
    return charts.card_histogram(t.dirty_events, "value")


@query("box_stats", f"""
    with {_BOUNDS}
    select round(any_value(q1), 6) as q1, round(any_value(q2), 6) as median, round(any_value(q3), 6) as q3,
      min(value) filter (value between lo and hi) as whisker_low, max(value) filter (value between lo and hi) as whisker_high
    from dirty_events, bounds""")
def _(t):
    return charts.box_stats(t.dirty_events, "value")


# Up to 500 outliers the sample holds all of them, which is so at the checked size
@query("outlier_sample", f"""
    with {_BOUNDS}
    select event_id, round(value, 6) as value from dirty_events, bounds where value < lo or value > hi limit 500""")
def _(t):
    return charts.outlier_sample(t.dirty_events, "value", ["event_id"])


@query("distribution_summary", f"""
    with {_BOUNDS}, s as (select count(value) as n, avg(value) as mean, median(value) as med, stddev_samp(value) as std, min(value) as lo, max(value) as hi,
      {sql_skew('value')} as skew from dirty_events)
    select 'rows' as measure, cast(n as double) as value from s union all select 'mean', round(mean, 6) from s union all
    select 'median', round(med, 6) from s union all select 'std', round(std, 6) from s union all select 'min', lo from s union all
    select 'max', hi from s union all select 'skewness', round(skew, 6) from s union all
    select 'outliers', cast((select count(*) from dirty_events, bounds where value < lo or value > hi) as double)""")
def _(t):
    return charts.distribution_summary(t.dirty_events, "value")


@query("density_comparison", _AFTER + """
    , both_sides as (select 'before' as moment, value as x from dirty_events where value is not null union all select 'after', value from after),
    s as (select moment, count(*) as n, stddev_samp(x) as std, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from both_sides group by moment),
    w as (select moment, n, 0.9 * case when iqr > 0 then least(std, iqr / 1.34) else std end * pow(n, -0.2) as bw from s),
    grid as (select lo + i * (hi - lo) / 199 as g from (select min(x) as lo, max(x) as hi from both_sides), range(200) r(i))
    select w.moment, round(g, 6) as value, round(sum(exp(-0.5 * pow((g - x) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) as density
    from grid, both_sides join w using (moment) group by w.moment, g""")
def _(t):
    return charts.density_comparison(t.dirty_events, _after(t), "value")


@query("stats_comparison", _AFTER + f"""
    , b as (select count(value) as n, avg(value) as mean, median(value) as med, stddev_samp(value) as std, {sql_skew('value')} as skew from dirty_events),
    a as (select count(value) as n, avg(value) as mean, median(value) as med, stddev_samp(value) as std, {sql_skew('value')} as skew from after)
    select 'rows' as measure, cast(b.n as double) as before, cast(a.n as double) as after from a, b
    union all select 'mean', round(b.mean, 6), round(a.mean, 6) from a, b union all select 'median', round(b.med, 6), round(a.med, 6) from a, b
    union all select 'std', round(b.std, 6), round(a.std, 6) from a, b union all select 'skewness', round(b.skew, 6), round(a.skew, 6) from a, b""")
def _(t):
    return charts.stats_comparison(t.dirty_events, _after(t), "value")


def _top_values_sql(expression, table, n=10):
    return f"""
    with f as (select coalesce({expression}, '(null)') as v, count(*) as n from {table} group by 1),
    r as (select v, n, row_number() over (order by n desc, v) as k, sum(n) over () as total, count(*) over () as kinds from f)
    select v as value, n as rows, round_even(n * 100.0 / total, 1) as pct, false as others from r where k <= {n}
    union all
    select 'others (' || (any_value(kinds) - {n}) || ')', cast(sum(n) as bigint), round_even(sum(n) * 100.0 / any_value(total), 1), true
    from r where k > {n} having count(*) > 0"""


@query("top_values", _top_values_sql("event_type", "dirty_events"))
def _(t):
    return charts.top_values(t.dirty_events, "event_type")


@query("top_values_with_others", _top_values_sql("cast(l_suppkey as varchar)", "lineitem"))
def _(t):
    return charts.top_values(t.lineitem, "l_suppkey")


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " union all ".join(
    f"select '{a}' as \"column\", " + ", ".join(f"round_even(corr({a}, {b}), 3) + 0.0 as {b}" for b in _NUMERIC) + " from lineitem" for a in _NUMERIC))
def _(t):
    return charts.correlation_matrix(t.lineitem)


_WIDE = {f"v{i}": f"cast((l_orderkey * {i} + l_partkey + l_linenumber) % {40 + 7 * i} as double)" for i in range(1, 15)}


@query("correlation_wide", "with d as (select " + ", ".join(f"{e} as {n}" for n, e in _WIDE.items()) + " from lineitem) " + " union all ".join(
    f"select '{a}' as \"column\", " + ", ".join(f"round_even(corr({a}, {b}), 3) + 0.0 as {b}" for b in _WIDE) + " from d" for a in _WIDE))
def _(t):
    return charts.correlation_matrix(t.lineitem.selectExpr(*(f"{e} as {n}" for n, e in _WIDE.items())))


_GAPPY = ("event_id", "user_id", "value", "constant")


@query("correlation_pairs", "with d as (select event_id, user_id, value, 7 as constant from dirty_events) select * from (" + " union all ".join(
    f"select '{a}' as x, '{b}' as y, round_even(r, 2) + 0.0 as r, abs(round_even(r, 2)) as strength from (select corr({a}, {b}) as r from d)"
    for a in _GAPPY[:3] for b in _GAPPY[:3]) + ")")
def _(t):
    return charts.correlation_pairs(t.dirty_events.select("event_id", "user_id", "value", F.lit(7).alias("constant")))
