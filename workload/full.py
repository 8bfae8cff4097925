"""Whole cleaning runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe import clean, prepare, run_pipeline, treat
from cleanframe.functions import text
from cleanframe.operators import impute, outliers, profile

from .registry import query, sql_boolean, sql_clean, sql_number, sql_skew, sql_title

c = F.col

# --- flagship: clip outliers, fill by skewness, report per type ---------------------------------

FLAGSHIP_SQL = f"""
    with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from dirty_events),
    clipped as (select event_type, case when value is not null then greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) end as value
      from dirty_events, q),
    s as (select case when abs({sql_skew('value')}) < 0.5 then avg(value) else median(value) end as fill from clipped)
    select event_type, count(*) as rows, round(avg(coalesce(value, fill)), 6) as mean_value from clipped, s group by event_type"""


def flagship(t):
    df = t.dirty_events.select("event_type", "value")
    clipped = outliers.treat_outliers(df, ["value"], action="clip")
    filled = impute.impute(clipped, ["value"], "auto")
    return filled.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean_value"))


query("clip_and_fill_by_type", FLAGSHIP_SQL)(flagship)


# --- prepare ------------------------------------------------------------------------------------

_PREPARE = {
    "drop": ["c_nationkey"], "rename": {"c_mktsegment": "segment", "c_custkey": ""}, "text": {"case": "Título"},
    "rules": [{"column": "segment", "find": "furniture", "replace": "home", "mode": "exato"},
              {"column": "name", "find": r"customer#0*(\d+)", "replace": r"C\1", "mode": "regex", "case": False}],
    "types": {"name": "texto"},
}


def _prepare_rows():
    def titled(n):
        return sql_clean(sql_title(rf"regexp_replace(trim({n}), '\s+', ' ', 'g')"))

    return f"""
    stepped as (select c_custkey, regexp_replace({titled('name')}, 'customer#0*(\\d+)', 'C\\1', 'gi') as name,
        {sql_number(titled('balance'))} as balance, {titled('active')} as active,
        case when lower(c_mktsegment) = 'furniture' then 'home' else {titled('c_mktsegment')} end as segment from doubled)"""


# Every fourth row once more
_DOUBLED = "with doubled as (select * from dirty_customer union all select * from dirty_customer where c_custkey % 4 = 0)"


def _doubled(t):
    return t.dirty_customer.unionByName(t.dirty_customer.where("c_custkey % 4 = 0"))


@query("prepare_run", _DOUBLED + "," + _prepare_rows() + " select distinct c_custkey, name, round(balance, 6) as balance, active, segment from stepped")
def _(t):
    return prepare(_doubled(t), _PREPARE).df


@query("prepare_log", _DOUBLED + "," + _prepare_rows() + """
    , hits as (select count(*) filter (lower(c_mktsegment) = 'furniture') as a, count(*) filter (regexp_matches(name, 'customer#', 'i')) as b,
        count(*) filter (balance = 'abc') as lost, count(*) filter (c_custkey % 4 = 0) as copied from doubled)
    select 'rule' as operation, 'segment' as "column", a as n_cells from hits union all select 'rule', 'name', b from hits
    union all select 'convert', 'balance', lost from hits
    union all select 'dedup', null, cast(copied / 2 as bigint) from hits""")
def _(t):
    log = prepare(_doubled(t), _PREPARE).log_frame(only_effective=True)
    return log.where("n_cells is not null").select("operation", "column", "n_cells")


# --- treat --------------------------------------------------------------------------------------

_KINDS = {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "categorical", "value": "numeric"}
_TREAT = {
    "columns": {"value": {"outliers": "remover"}, "user_id": {"outliers": "limitar"}, "event_type": {"impute": "moda"}},
    "filters": [{"column": "user_id", "operator": ">=", "value": "10"}],
}
_TREATED = f"""
    q as (select quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as lo,
      quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as hi from dirty_events),
    flagged as (select *, coalesce(value < lo or value > hi, false) as out from dirty_events, q),
    kept as (select * from flagged where not out),
    s as (select case when abs({sql_skew('value')}) < 0.5 then avg(value) else median(value) end as fill from kept),
    m as (select event_type as mode from kept where event_type is not null group by 1 order by count(*) desc, event_type limit 1),
    filled as (select event_id, ts, user_id, coalesce(event_type, mode) as event_type, coalesce(value, fill) as value,
      event_type is null as event_type_imputed, value is null as value_imputed from kept, s, m)"""


@query("treat_run", f"with {_TREATED} select event_id, ts, user_id, event_type, round(value, 6) as value, event_type_imputed, value_imputed from filled where user_id >= 10")
def _(t):
    return treat(t.dirty_events, _TREAT, _KINDS).rows


@query("treat_log", f"""
    with {_TREATED}, n as (select count(*) filter (out) as outs from flagged), k as (select count(*) filter (event_type_imputed) as e,
      count(*) filter (value_imputed) as v, count(*) filter (user_id < 10) as f from filled)
    select 'outliers' as operation, 'value' as "column", outs as n_cells from n union all select 'remove', null, outs from n
    union all select 'impute', 'event_type', e from k union all select 'impute', 'value', v from k union all select 'filter', 'user_id', f from k""")
def _(t):
    return treat(t.dirty_events, _TREAT, _KINDS).log_frame(only_effective=True).select("operation", "column", "n_cells")


@query("treat_counters", f"""
    with {_TREATED}
    select (select count(*) filter (event_type_imputed) + count(*) filter (value_imputed) from filled) as imputed,
      (select count(*) filter (out) from flagged) as outliers,
      (select count(*) filter (out) from flagged) + (select count(*) filter (user_id < 10) from filled) as rows_removed""")
def _(t):
    counts = treat(t.dirty_events, _TREAT, _KINDS).counters()
    return t.spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


@query("treat_ordered", f"""
    with required as (select * from dirty_events where event_type is not null),
    q as (select quantile_cont(value, 0.25) - 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as lo,
      quantile_cont(value, 0.75) + 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as hi from required),
    emptied as (select event_id, ts, user_id, event_type, case when value between lo and hi then value end as value from required, q)
    select event_id, ts, user_id, event_type,
      round(last_value(value ignore nulls) over (order by ts rows between unbounded preceding and current row), 6) as value,
      value is null and last_value(value ignore nulls) over (order by ts rows between unbounded preceding and current row) is not null as value_imputed from emptied""")
def _(t):
    cfg = {"drop_null_rows": ["event_type"], "iqr_factor": 3.0, "columns": {"value": {"outliers": "null", "impute": "forward"}}}
    return treat(t.dirty_events, cfg, _KINDS, order_by=["ts"]).rows


# --- step list -----------------------------------------------------------------------------------

_STEPS = {
    "drop_columns": ["c_nationkey"], "rename": {"c_mktsegment": "Market Segment"}, "snake_case": True,
    "conversions": {"balance": "número", "active": "booleano"}, "decimal_comma": True,
    "text_columns": ["name", "market_segment", "balance"], "text_options": {"case": "minúsculas", "accents": True},
    "dup_null": {"drop_duplicates": True, "drop_null_rows_in": ["active"], "drop_cols_threshold": 90.0},
    "impute_columns": ["balance", "name"], "impute_method": "automática (Pearson)",
    "outlier_columns": ["balance"], "outlier_method": "IQR", "outlier_factor": 0.5, "outlier_action": "limitar (winsorizar)",
    "filters": [{"column": "market_segment", "operator": "não contém", "value": "AUTO"}, {"column": "missing", "operator": "==", "value": "1"}],
}


@query("step_list_run", _DOUBLED + f""",
    typed as (select distinct c_custkey, {sql_clean("strip_accents(lower(name))")} as name, {sql_number('balance')} as balance,
      {sql_boolean('active')} as active, lower(c_mktsegment) as market_segment from doubled),
    kept as (select * from typed where active is not null),
    s as (select case when abs({sql_skew('balance')}) < 0.5 then avg(balance) else median(balance) end as fill from kept),
    m as (select name as mode from kept where name is not null group by 1 order by count(*) desc, name limit 1),
    filled as (select c_custkey, coalesce(name, mode) as name, coalesce(balance, fill) as balance, active, market_segment from kept, s, m),
    q as (select quantile_cont(balance, 0.25) as q1, quantile_cont(balance, 0.75) as q3 from filled)
    select c_custkey, name, round(greatest(least(balance, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)), 6) as balance, active, market_segment
    from filled, q where not contains(market_segment, 'auto')""")
def _(t):
    return run_pipeline(_doubled(t), _STEPS)[0]


# --- full run -------------------------------------------------------------------------------------

def _identified(t):
    first = t.dirty_customer.withColumn("row_id", c("c_custkey"))
    return first.unionByName(t.dirty_customer.where("c_custkey % 4 = 0").withColumn("row_id", c("c_custkey") + 1_000_000_000))


_CLEANED = f"""
    with prep as (select c_custkey, c_custkey as row_id, {sql_clean('name')} as name, c_nationkey,
      {sql_number(sql_clean('balance'))} as balance, {sql_clean('active')} as active, c_mktsegment from dirty_customer),
    q as (select quantile_cont(balance, 0.25) - 1.5 * (quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25)) as lo,
      quantile_cont(balance, 0.75) + 1.5 * (quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25)) as hi from prep),
    s as (select case when abs({sql_skew('balance')}) < 0.5 then avg(balance) else median(balance) end as fill from prep),
    m as (select active as mode from prep where active is not null group by 1 order by count(*) desc, active limit 1),
    cleaned as (select prep.*, coalesce(active, mode) as active2, coalesce(balance, fill) as balance2 from prep, s, m)"""


@query("full_run", _CLEANED + """
    select c_custkey, name, c_nationkey, round(balance2, 6) as balance, active2 as active, c_mktsegment from cleaned""")
def _(t):
    return clean(_identified(t)).df


@query("full_run_changes", _CLEANED + f"""
    select c.row_id, d.name is distinct from c.name as name_changed, c.balance is null as balance_changed, d.active is distinct from c.active2 as active_changed
    from cleaned c join dirty_customer d using (c_custkey)""")
def _(t):
    return clean(_identified(t)).changed().select("row_id", "name_changed", "balance_changed", "active_changed")


@query("full_run_summary", _CLEANED + f"""
    select (select count(*) from dirty_customer where c_custkey % 4 = 0) as duplicates,
      (select count(*) filter (balance is null) + count(*) filter (active is null) from cleaned) as imputed,
      (select count(*) filter (balance < lo or balance > hi) from prep, q)
        + (select count(*) filter (c_custkey < lo or c_custkey > hi) from prep, (select quantile_cont(c_custkey, 0.25) - 1.5 * (quantile_cont(c_custkey, 0.75) - quantile_cont(c_custkey, 0.25)) as lo,
            quantile_cont(c_custkey, 0.75) + 1.5 * (quantile_cont(c_custkey, 0.75) - quantile_cont(c_custkey, 0.25)) as hi from prep))
        + (select count(*) filter (c_nationkey < lo or c_nationkey > hi) from prep, (select quantile_cont(c_nationkey, 0.25) - 1.5 * (quantile_cont(c_nationkey, 0.75) - quantile_cont(c_nationkey, 0.25)) as lo,
            quantile_cont(c_nationkey, 0.75) + 1.5 * (quantile_cont(c_nationkey, 0.75) - quantile_cont(c_nationkey, 0.25)) as hi from prep)) as outliers,
      3 as problem_columns,
      round((select (count(c_custkey) + count(name) + count(c_nationkey) + count(balance) + count(active) + count(c_mktsegment)) * 100.0 / (count(*) * 6) from cleaned), 6) as quality_before,
      round((select (count(c_custkey) + count(name) + count(c_nationkey) + count(balance2) + count(active2) + count(c_mktsegment)) * 100.0 / (count(*) * 6) from cleaned), 6) as quality_after""".replace("3 as problem", "cast(3 as bigint) as problem"))
def _(t):
    return clean(_identified(t)).summary()


@query("full_run_log", _CLEANED + """
    select 'convert' as operation, 'balance' as "column", count(*) filter (balance = 'abc') + count(*) filter (balance = 'abc' and c_custkey % 4 = 0) as n_cells from dirty_customer
    union all select 'dedup', null, count(*) from dirty_customer where c_custkey % 4 = 0
    union all select 'impute', 'balance', count(*) filter (balance is null) from cleaned
    union all select 'impute', 'active', count(*) filter (active is null) from cleaned""")
def _(t):
    return clean(_identified(t)).log_frame().where("n_cells is not null").select("operation", "column", "n_cells")
