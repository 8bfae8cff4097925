"""Value rules, duplicates, filters, outliers and change tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.operators import changes, outliers, rows, rules

from .registry import query, sql_clean

c = F.col


# --- value rules ----------------------------------------------------------------------------

def _rule(column, find, replace, mode="exact", case=False):
    return {"column": column, "find": find, "replace": replace, "mode": mode, "case": case}


@query("rule_exact_number", """
    select o_orderkey, case when o_custkey = 7 then 700 else o_custkey end as o_custkey,
      nullif(o_orderkey % 5, 3) as remainder from orders""")
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", (c("o_orderkey") % 5).alias("remainder"))
    return rules.apply_rules(df, [_rule("o_custkey", "7,0", "700"), _rule("remainder", "3", "")]).df


@query("rule_exact_number_to_text", """
    select c_custkey, case when c_nationkey = 3 then 'three' else cast(c_nationkey as varchar) end as c_nationkey from customer""")
def _(t):
    return rules.apply_rules(t.customer.select("c_custkey", "c_nationkey"), [_rule("c_nationkey", "3", "three")]).df


@query("rule_exact_text", """
    select event_id, case when lower(event_type) = 'click' then 'tap' when event_type = 'view' then null
      else event_type end as event_type from dirty_events""")
def _(t):
    df = t.dirty_events.select("event_id", "event_type")
    chain = [_rule("event_type", "CLICK", "tap"), _rule("event_type", "view", "", case=True), _rule("event_type", "ERROR", "x", case=True)]
    return rules.apply_rules(df, chain).df


@query("rule_contains", r"""
    select c_custkey, case when name ilike '%josé%' then nullif(trim(regexp_replace(name, 'josé', '$1\\', 'gi')), '') is not null end as hit,
      case when name ilike '%customer#%' then regexp_replace(name, 'customer#', 'C.$', 'gi') else name end as name
    from dirty_customer""")
def _(t):
    df = t.dirty_customer.select("c_custkey", "name")
    flagged = df.withColumn("hit", F.when(F.lower("name").contains("josé"), F.lit(True)))
    return rules.apply_rules(flagged, [_rule("name", "customer#", "C.$", "contains")]).df


@query("rule_contains_blank", """
    select c_custkey, case when contains(c_mktsegment, 'BUILDING') then nullif(trim(replace(c_mktsegment, 'BUILDING', '')), '')
      else c_mktsegment end as c_mktsegment from customer""")
def _(t):
    df = t.customer.select("c_custkey", "c_mktsegment")
    return rules.apply_rules(df, [_rule("c_mktsegment", "BUILDING", "", "contains", True)]).df


@query("rule_regex", r"""
    select o_orderkey, regexp_replace(order_date, '(\d+)/(\d+)/(\d+)', '\3-\2-\1', 'g') as order_date from text_dates""")
def _(t):
    chain = [_rule("order_date", r"(?P<day>\d+)/(\d+)/(\d+)", r"\3-\2-\g<day>", "regex"), _rule("order_date", "(", "x", "regex")]
    return rules.apply_rules(t.text_dates, chain).df


@query("rule_all_columns", """
    select case when c_custkey = 5 then 55 else c_custkey end as c_custkey,
      case when c_nationkey = 5 then 55 else c_nationkey end as c_nationkey, c_name, c_mktsegment from customer""")
def _(t):
    df = t.customer.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    return rules.apply_rules(df, [_rule(None, "5", "55")]).df


_CHAIN = [
    _rule("event_type", "click", "tap"), _rule("event_type", "tap", "touch"), _rule("event_type", "^s(.*)p$", r"\1", "regex"),
    _rule(None, "ou", "OU", "contains"), _rule("value", "10", ""),
]
_CHAIN_SQL = r"""
    with first as (select event_id, value, case when lower(event_type) in ('click', 'tap') then 'touch' else event_type end as e from dirty_events),
    second as (select event_id, value, regexp_replace(e, '^s(.*)p$', '\1', 'i') as e from first)
    select event_id, round(nullif(value, 10), 6) as value, regexp_replace(e, 'ou', 'OU', 'gi') as event_type from second"""


@query("rule_chain", _CHAIN_SQL)
def _(t):
    return rules.apply_rules(t.dirty_events.select("event_id", "event_type", "value"), _CHAIN).df


@query("rule_hits", r"""
    select 1 as rule, 'event_type' as "column", 'exact' as mode, count(*) filter (event_type = 'click') as hits from dirty_events
    union all select 2, 'event_type', 'exact', count(*) filter (event_type = 'click') from dirty_events
    union all select 3, 'event_type', 'regex', count(*) filter (event_type = 'signup') from dirty_events
    union all select 4, null, 'contains', count(*) filter (event_type = 'click') from dirty_events
    union all select 5, 'value', 'exact', count(*) filter (value = 10) from dirty_events""")
def _(t):
    return rules.apply_rules(t.dirty_events.select("event_id", "event_type", "value"), _CHAIN).hit_counts()


# --- duplicates and nulls ---------------------------------------------------------------------

@query("drop_duplicates", "select distinct * from dup_orders")
def _(t):
    return rows.drop_duplicates(t.dup_orders)


_NUMBERED = """
    with numbered as (
      select *, o_orderkey as row_id from orders union all
      select *, o_orderkey + 1000000000 from orders where o_orderkey % 10 = 0)"""


def _numbered(t):
    first = t.orders.withColumn("row_id", c("o_orderkey"))
    copies = t.orders.where("o_orderkey % 10 = 0").withColumn("row_id", c("o_orderkey") + 1000000000)
    return first.unionByName(copies)


@query("drop_duplicates_first_copy", _NUMBERED + """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, min(row_id) as row_id
    from numbered group by all""")
def _(t):
    return rows.drop_duplicates(_numbered(t), row_id="row_id")


@query("dedup_subset_first", """
    select * from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) = 1""")
def _(t):
    return rows.drop_duplicates_on(t.orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])


@query("dedup_subset_last", """
    select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def _(t):
    return rows.drop_duplicates_on(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], keep="last")


@query("dedup_text_first", """
    select doc_id, lang, source from documents qualify row_number() over (partition by text order by doc_id) = 1""")
def _(t):
    return rows.drop_duplicates_on(t.documents.select("doc_id", "lang", "source", "text"), ["text"], ["doc_id"]).drop("text")


@query("dedup_none", """
    select * from dup_orders qualify count(*) over (partition by o_orderkey) = 1""")
def _(t):
    return rows.drop_repeated(t.dup_orders, ["o_orderkey"])


@query("dedup_none_full_rows", """
    select * from dup_orders qualify count(*) over (partition by o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) = 1""")
def _(t):
    return rows.drop_repeated(t.dup_orders)


@query("drop_null_rows", """
    select event_id, event_type, round(value, 6) as value from dirty_events where event_type is not null and value is not null""")
def _(t):
    return rows.drop_null_rows(t.dirty_events.select("event_id", "event_type", "value"), ["event_type", "value"])


@query("drop_null_columns", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber,
      case when l_orderkey % 2 = 0 then l_tax end as half from lineitem""")
def _(t):
    df = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(c("l_orderkey") % 2 == 0, c("l_tax")).alias("half"),
        F.when(c("l_orderkey") % 10 == 0, c("l_tax")).alias("sparse"),
    )
    return rows.drop_null_columns(df, 75.0)


# --- filters --------------------------------------------------------------------------------

def _filter(column, operator, value=""):
    return {"column": column, "operator": operator, "value": value}


@query("filter_comparisons", """
    select event_id, ts, event_type, round(value, 6) as value from dirty_events
    where value >= 12.5 and value < 900 and value <> 20 and ts >= timestamp '2024-01-02' and event_type > 'click'""")
def _(t):
    df = t.dirty_events.select("event_id", "ts", "event_type", "value")
    return rows.apply_filters(df, [
        _filter("value", ">=", "12,5"), _filter("value", "<", "900"), _filter("value", "!=", 20),
        _filter("ts", ">=", "02/01/2024"), _filter("event_type", ">", "click"), _filter("value", "==", "abc"),
    ]).df


@query("filter_not_equal_drops_nulls", "select event_id, event_type from dirty_events where event_type <> 'view'")
def _(t):
    return rows.apply_filters(t.dirty_events.select("event_id", "event_type"), [_filter("event_type", "!=", "view")]).df


@query("filter_contains", """
    select event_id, event_type from dirty_events where coalesce(contains(lower(event_type), 'i'), false)
      and not coalesce(contains(lower(event_type), 'ew'), false)""")
def _(t):
    df = t.dirty_events.select("event_id", "event_type")
    return rows.apply_filters(df, [_filter("event_type", "contains", "I"), _filter("event_type", "not contains", "eW")]).df


@query("filter_not_contains_keeps_nulls", """
    select event_id, event_type from dirty_events where not coalesce(contains(lower(event_type), 'e'), false)""")
def _(t):
    return rows.apply_filters(t.dirty_events.select("event_id", "event_type"), [_filter("event_type", "not contains", "E")]).df


@query("filter_nulls", "select event_id, ts from dirty_events where value is null and event_type is not null")
def _(t):
    chained = rows.apply_filters(t.dirty_events, [_filter("value", "is null"), _filter("event_type", "is not null")])
    return chained.df.select("event_id", "ts")


_FILTERS = [_filter("value", ">", "5"), _filter("event_type", "contains", "c"), _filter("value", ">", "x"), _filter("user_id", "<=", "100")]


@query("filter_chain", """
    select event_id, user_id from dirty_events where value > 5 and contains(event_type, 'c') and user_id <= 100""")
def _(t):
    return rows.apply_filters(t.dirty_events, _FILTERS).df.select("event_id", "user_id")


@query("filter_chain_counts", """
    with n as (select count(*) as n0, count(*) filter (value > 5) as n1,
        count(*) filter (value > 5 and contains(event_type, 'c')) as n2,
        count(*) filter (value > 5 and contains(event_type, 'c') and user_id <= 100) as n4 from dirty_events)
    select 1 as filter, 'value' as "column", '>' as operator, '5' as value, false as skipped, n0 - n1 as removed from n
    union all select 2, 'event_type', 'contains', 'c', false, n1 - n2 from n
    union all select 3, 'value', '>', 'x', true, 0 from n
    union all select 4, 'user_id', '<=', '100', false, n2 - n4 from n""")
def _(t):
    return rows.apply_filters(t.dirty_events, _FILTERS).removed_counts()


# --- outliers ----------------------------------------------------------------------------------

IQR_SQL = """
    bounds as (
      select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
        select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from dirty_events))"""


@query("iqr_bounds", """
    with q as (
      select 'value' as "column", quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from dirty_events union all
      select 'user_id', quantile_cont(user_id, 0.25), quantile_cont(user_id, 0.75) from dirty_events),
    b as (select "column", q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q)
    select "column", round(low, 6) as low, round(high, 6) as high,
      (select count(*) from dirty_events where case when b."column" = 'value' then value else user_id end < b.low
        or case when b."column" = 'value' then value else user_id end > b.high) as outliers from b""")
def _(t):
    return outliers.bounds_frame(t.dirty_events, ["value", "user_id"])


@query("iqr_bounds_lineitem", """
    with q as (
      select 'l_quantity' as "column", quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from lineitem union all
      select 'l_extendedprice', quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.75) from lineitem union all
      select 'l_discount', quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.75) from lineitem union all
      select 'l_tax', quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.75) from lineitem),
    b as (select "column", q1 - 0.5 * (q3 - q1) as low, q3 + 0.5 * (q3 - q1) as high from q),
    v as (unpivot lineitem on l_quantity, l_extendedprice, l_discount, l_tax into name "column" value x)
    select b."column", round(low, 6) as low, round(high, 6) as high, count(*) filter (x < low or x > high) as outliers
    from b join v using ("column") group by all""")
def _(t):
    return outliers.bounds_frame(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], factor=0.5)


@query("z_score_bounds", """
    with b as (select avg(l_extendedprice) - 1.5 * stddev_samp(l_extendedprice) as low,
        avg(l_extendedprice) + 1.5 * stddev_samp(l_extendedprice) as high from lineitem)
    select 'l_extendedprice' as "column", round(low, 6) as low, round(high, 6) as high,
      (select count(*) from lineitem where l_extendedprice < low or l_extendedprice > high) as outliers from b""")
def _(t):
    return outliers.bounds_frame(t.lineitem, ["l_extendedprice"], "z-score")


@query("flag_outliers", f"""
    with {IQR_SQL}
    select event_id, coalesce(value < lo or value > hi, false) as value_outlier from dirty_events, bounds""")
def _(t):
    df = t.dirty_events
    return outliers.flag_outliers(df, outliers.outlier_bounds(df, ["value"])).select("event_id", "value_outlier")


@query("remove_outlier_rows", """
    with b as (
      select quantile_cont(l_quantity, 0.25) as a1, quantile_cont(l_quantity, 0.75) as a3,
        quantile_cont(l_extendedprice, 0.25) as b1, quantile_cont(l_extendedprice, 0.75) as b3 from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem, b
    where not (l_quantity < a1 - 0.4 * (a3 - a1) or l_quantity > a3 + 0.4 * (a3 - a1)
      or l_extendedprice < b1 - 0.4 * (b3 - b1) or l_extendedprice > b3 + 0.4 * (b3 - b1))""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return outliers.treat_outliers(df, ["l_quantity", "l_extendedprice"], factor=0.4)


@query("winsorize", f"""
    with {IQR_SQL},
    k as (select q1 - 0.1 * (q3 - q1) as lo, q3 + 0.1 * (q3 - q1) as hi from (
      select quantile_cont(user_id, 0.25) as q1, quantile_cont(user_id, 0.75) as q3 from dirty_events))
    select event_id, round(case when value is not null then greatest(least(value, bounds.hi), bounds.lo) end, 6) as value,
      cast(round_even(greatest(least(user_id, k.hi), k.lo), 0) as bigint) as user_id from dirty_events, bounds, k""")
def _(t):
    df = t.dirty_events.select("event_id", "value", "user_id")
    clipped = outliers.treat_outliers(df, ["value"], action="clip")
    return outliers.treat_outliers(clipped, ["user_id"], factor=0.1, action="clip")


@query("outliers_to_null", f"""
    with {IQR_SQL}
    select event_id, round(case when value between lo and hi then value end, 6) as value from dirty_events, bounds""")
def _(t):
    return outliers.treat_outliers(t.dirty_events.select("event_id", "value"), ["value"], action="null")


@query("outlier_actions_per_column", f"""
    with {IQR_SQL},
    k as (select q1 - 0.9 * (q3 - q1) as lo, q3 + 0.9 * (q3 - q1) as hi from (
      select quantile_cont(user_id, 0.25) as q1, quantile_cont(user_id, 0.75) as q3 from dirty_events))
    select event_id, round(case when value between bounds.lo and bounds.hi then value end, 6) as value, user_id
    from dirty_events, bounds, k where user_id between k.lo and k.hi""")
def _(t):
    df = t.dirty_events.select("event_id", "value", "user_id")
    bounds = {**outliers.outlier_bounds(df, ["value"]), **outliers.outlier_bounds(df, ["user_id"], factor=0.9)}
    return outliers.apply_actions(df, bounds, {"value": "null", "user_id": "remove"})


@query("z_score_remove", """
    with b as (select avg(o_totalprice) - 1.5 * stddev_samp(o_totalprice) as lo, avg(o_totalprice) + 1.5 * stddev_samp(o_totalprice) as hi from orders)
    select o_orderkey, round(o_totalprice, 6) as o_totalprice from orders, b where o_totalprice between lo and hi""")
def _(t):
    return outliers.treat_outliers(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], "z-score")


# --- changed cells ---------------------------------------------------------------------------------

def _changed(t):
    raw = t.dirty_events.withColumn("row_id", c("event_id"))
    bounds = outliers.outlier_bounds(raw, ["value"])
    out = outliers.apply_actions(raw, bounds, {"value": "clip"}).withColumn("event_type", F.coalesce("event_type", F.lit("none")))
    out = out.where("event_id % 50 <> 1")
    kinds = {"value": "numeric", "event_type": "categorical", "event_id": "numeric", "user_id": "numeric", "ts": "date"}
    return changes.changed_cells(raw, out.select("row_id", "event_type", "value", "ts"), "row_id", kinds)


_CHANGED_SQL = f"""
    with {IQR_SQL},
    changed as (
      select event_id as row_id, coalesce(event_type, 'none') as event_type,
        case when value is not null then greatest(least(value, hi), lo) end as value, ts,
        event_type is null as event_type_changed, coalesce(value < lo or value > hi, false) as value_changed, false as ts_changed
      from dirty_events, bounds where event_id % 50 <> 1)"""


@query("changed_cells", _CHANGED_SQL + "select row_id, event_type, round(value, 6) as value, ts, event_type_changed, value_changed, ts_changed from changed")
def _(t):
    return _changed(t)


@query("changed_rows_view", _CHANGED_SQL + """
    select row_id, event_type, round(value, 6) as value, ts, event_type_changed, value_changed, ts_changed,
      event_type_changed or value_changed as row_changed, row_id + 1 as source_row
    from changed order by row_changed desc, row_id limit 1000""")
def _(t):
    return changes.changed_rows(_changed(t), "row_id")


@query("changed_rows_only", _CHANGED_SQL + """
    select row_id, event_type, round(value, 6) as value, ts, event_type_changed, value_changed, ts_changed,
      event_type_changed or value_changed as row_changed, row_id + 1 as source_row
    from changed where event_type_changed or value_changed order by row_id limit 100""")
def _(t):
    return changes.changed_rows(_changed(t), "row_id", only_changed=True, limit=100)


@query("change_counts", _CHANGED_SQL + """
    select 'event_type' as "column", count(*) filter (event_type_changed) as cells from changed
    union all select 'value', count(*) filter (value_changed) from changed
    union all select 'ts', 0 from changed where row_id = 0""")
def _(t):
    return changes.change_counts(_changed(t))


@query("changed_cells_ignore_format", f"""
    select c_custkey as row_id, {sql_clean('name')} as name, name is distinct from {sql_clean('name')} as name_changed,
      false as balance_changed from dirty_customer""")
def _(t):
    from cleanframe.operators.kinds import convert_kinds
    from cleanframe.operators.text import standardise_text

    raw = t.dirty_customer.select(c("c_custkey").alias("row_id"), "name", "balance")
    kinds = {"name": "text", "balance": "numeric"}
    out = convert_kinds(standardise_text(raw, ["name", "balance"]), kinds, {"balance": True})
    return changes.changed_cells(raw, out, "row_id", kinds).drop("balance")
