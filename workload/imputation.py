"""Filling of nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.operators import impute, order

from .registry import query, sql_skew

c = F.col


def _values(t):
    """Nulls in a double, a whole number and a category."""
    return t.dirty_events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.when(c("event_id") % 4 != 1, c("user_id")).alias("visits"),
    )


_VALUES = """
    with d as (select event_id, ts, user_id, event_type, value, case when event_id % 4 <> 1 then user_id end as visits from dirty_events)"""


def _constant_sql(value, visits):
    return _VALUES + f"""
    select event_id, round(coalesce(value, (select {value} from d)), 6) as value,
      coalesce(visits, (select cast({visits} as bigint) from d)) as visits from d"""


@query("impute_mean", _constant_sql("avg(value)", "round_even(avg(visits), 0)"))
def _(t):
    return impute.impute(_values(t), ["value", "visits"], "mean").select("event_id", "value", "visits")


@query("impute_median", _constant_sql("median(value)", "round_even(median(visits), 0)"))
def _(t):
    return impute.impute(_values(t), ["value", "visits"], "median").select("event_id", "value", "visits")


@query("impute_mode", _VALUES + """
    , m as (select event_type as v from d where event_type is not null group by 1 order by count(*) desc, event_type limit 1),
    n as (select visits as v from d where visits is not null group by 1 order by count(*) desc, visits limit 1),
    k as (select value as v from d where value is not null group by 1 order by count(*) desc, value limit 1)
    select event_id, coalesce(event_type, m.v) as event_type, coalesce(visits, n.v) as visits, round(coalesce(value, k.v), 6) as value
    from d, m, n, k""")
def _(t):
    return impute.impute(_values(t), ["event_type", "visits", "value"], "mode").select("event_id", "event_type", "visits", "value")


@query("impute_fixed", _VALUES + """
    select event_id, round(coalesce(value, 7.25), 6) as value, coalesce(visits, 7) as visits, coalesce(event_type, '7,25') as event_type from d""")
def _(t):
    filled = impute.impute(_values(t), ["value", "visits", "event_type"], "fixed", "7,25")
    return filled.select("event_id", "value", "visits", "event_type")


def _forward_sql(order="ts", keys=""):
    w = f"({'partition by ' + keys if keys else ''} order by {order} rows between unbounded preceding and current row)"
    return f"last_value(value ignore nulls) over {w}", f"last_value(event_type ignore nulls) over {w}"


_F = _forward_sql()
_B = tuple(s.replace("order by ts", "order by ts desc") for s in _F)


@query("fill_forward", f"select event_id, round({_F[0]}, 6) as value, {_F[1]} as event_type from dirty_events")
def _(t):
    filled = impute.impute(t.dirty_events, ["value", "event_type"], "forward", order_by=["ts"])
    return filled.select("event_id", "value", "event_type")


@query("fill_forward_text", """
    select doc_id, last_value(hidden ignore nulls) over (order by doc_id rows between unbounded preceding and current row) as text
    from (select doc_id, case when doc_id % 7 >= 3 then text end as hidden from documents)""")
def _(t):
    hidden = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 >= 3, F.col("text")).alias("text"))
    return impute.impute(hidden, ["text"], "forward", order_by=["doc_id"])


@query("fill_backward", f"select event_id, round({_B[0]}, 6) as value, {_B[1]} as event_type from dirty_events")
def _(t):
    filled = impute.impute(t.dirty_events, ["value", "event_type"], "backward", order_by=["ts"])
    return filled.select("event_id", "value", "event_type")


@query("fill_forward_by_position", f"select event_id, round({_F[0].replace('ts', 'event_id')}, 6) as value from dirty_events")
def _(t):
    # event_id is already a dense position: no cut, no copy, one shuffle
    filled = order.fill_ordered(t.dirty_events, {"value": "forward"}, position="event_id", rows_per_chunk=2_000)
    return filled.select("event_id", "value")


_K = _forward_sql(keys="user_id")


@query("fill_forward_by_key", f"select event_id, round({_K[0]}, 6) as value from dirty_events")
def _(t):
    filled = impute.impute(t.dirty_events, ["value"], "forward", order_by=["ts"], partition_by=["user_id"])
    return filled.select("event_id", "value")


@query("fill_backward_by_hot_key", """
    with d as (select event_id, ts, value, case when event_id % 3 = 0 then null else user_id % 4 end as k from dirty_events)
    select event_id, round(last_value(value ignore nulls) over (partition by k order by ts desc rows between unbounded preceding and current row), 6) as value from d""")
def _(t):
    df = t.dirty_events.select("event_id", "ts", "value", F.when(c("event_id") % 3 != 0, c("user_id") % 4).alias("k"))
    return impute.impute(df, ["value"], "backward", order_by=["ts"], partition_by=["k"]).select("event_id", "value")


def _interpolate_sql(keys=""):
    by = f"partition by {keys}" if keys else ""
    sides = f"""
      last_value(case when value is not null then pos end ignore nulls) over ({by} order by pos rows between unbounded preceding and current row) as pp,
      last_value(value ignore nulls) over ({by} order by pos rows between unbounded preceding and current row) as pv,
      last_value(case when value is not null then pos end ignore nulls) over ({by} order by pos desc rows between unbounded preceding and current row) as np,
      last_value(value ignore nulls) over ({by} order by pos desc rows between unbounded preceding and current row) as nv"""
    return f"""
    with p as (select *, row_number() over ({by} order by ts) as pos from dirty_events),
    s as (select *, {sides} from p)
    select event_id, round(coalesce(value, pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0), pv, nv), 6) as value from s"""


@query("interpolate", _interpolate_sql())
def _(t):
    return impute.impute(t.dirty_events, ["value"], "interpolate", order_by=["ts"]).select("event_id", "value")


@query("interpolate_by_key", _interpolate_sql("event_type"))
def _(t):
    filled = impute.impute(t.dirty_events, ["value"], "interpolate", order_by=["ts"], partition_by=["event_type"])
    return filled.select("event_id", "value")


@query("interpolate_integers", """
    with p as (select event_id, case when event_id % 4 <> 1 and event_id > 2 then user_id end as v from events),
    s as (select *,
      last_value(case when v is not null then event_id end ignore nulls) over (order by event_id) as pp, last_value(v ignore nulls) over (order by event_id) as pv,
      last_value(case when v is not null then event_id end ignore nulls) over (order by event_id desc) as np, last_value(v ignore nulls) over (order by event_id desc) as nv from p)
    select event_id, coalesce(v, cast(round_even(coalesce(pv + (nv - pv) * cast(event_id - pp as double) / nullif(np - pp, 0), pv, nv), 0) as bigint)) as v from s""")
def _(t):
    df = t.events.select("event_id", F.when((c("event_id") % 4 != 1) & (c("event_id") > 2), c("user_id")).alias("v"))
    return impute.impute(df, ["v"], "interpolate", order_by=["event_id"])


@query("impute_automatic", _VALUES + f"""
    , s as (select {sql_skew('value')} as a, {sql_skew('visits')} as b, avg(value) as va, median(value) as vm, avg(visits) as ia, median(visits) as im from d),
    m as (select event_type as v from d where event_type is not null group by 1 order by count(*) desc, event_type limit 1)
    select event_id, round(coalesce(value, case when abs(a) < 0.5 then va else vm end), 6) as value,
      coalesce(visits, cast(round_even(case when abs(b) < 0.5 then ia else im end, 0) as bigint)) as visits,
      coalesce(event_type, m.v) as event_type from d, s, m""")
def _(t):
    filled = impute.impute(_values(t), ["value", "visits", "event_type"], "auto")
    return filled.select("event_id", "value", "visits", "event_type")


_KINDS = {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "categorical", "value": "numeric", "visits": "numeric"}


@query("recommend_methods", _VALUES + f"""
    , m as (select event_type as v, count(*) as n from d where event_type is not null group by 1 order by count(*) desc, event_type limit 1),
    s as (select 'value' as "column", {sql_skew('value')} as k, avg(value) as a, median(value) as b from d
      union all select 'visits', {sql_skew('visits')}, avg(visits), median(visits) from d)
    select "column", case when abs(k) < 0.5 then 'mean' else 'median' end as method,
      case when abs(k) < 0.5 then 'symmetric' else 'skewed' end as shape from s
    union all select 'event_type', 'mode', 'categorical' from m
    union all select 'ts', 'forward', 'dates'""")
def _(t):
    kinds = {n: _KINDS[n] for n in ("value", "visits", "event_type", "ts")}
    found = impute.recommend(_values(t), kinds)
    return found.select("column", "method", F.split("reason", " ")[0].alias("shape"))


@query("impute_per_column", _VALUES + f"""
    , s as (select median(visits) as im from d)
    select event_id, round({_B[0].replace('event_type', 'event_type')}, 6) as value,
      coalesce(visits, cast(round_even(im, 0) as bigint)) as visits, event_type from d, s""")
def _(t):
    df = _values(t)
    fills = impute.plan_fills(df, _KINDS, {"value": "seguinte", "visits": "median", "event_type": "keep"})
    return impute.apply_fills(df, fills, order_by=["ts"]).select("event_id", "value", "visits", "event_type")


@query("impute_keep", "select event_id, event_type, round(value, 6) as value from dirty_events")
def _(t):
    df = t.dirty_events.select("event_id", "event_type", "value")
    fills = impute.plan_fills(df, _KINDS, {"value": "keep", "event_type": "preservar"})
    return impute.apply_fills(df, fills)


@query("imputed_mask", """
    with f as (select event_id, value is null as was_null,
      last_value(value ignore nulls) over (order by ts rows between unbounded preceding and current row) as v from dirty_events)
    select event_id, was_null and v is not null as imputed from f""")
def _(t):
    df = t.dirty_events.withColumn("was_null", c("value").isNull())
    filled = impute.impute(df, ["value"], "forward", order_by=["ts"])
    return filled.select("event_id", impute.imputed_mask("was_null", c("value")).alias("imputed"))
