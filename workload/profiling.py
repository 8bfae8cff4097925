"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.operators import frequency, impute, profile

from .registry import query, sql_skew

c = F.col

_ALL = ("event_id", "ts", "user_id", "event_type", "value")


def _union(template, names=_ALL):
    return " union all ".join(template.format(n=n) for n in names)


@query("null_table", _union("""
    select '{n}' as "column", count(*) - count({n}) as nulls, round_even((count(*) - count({n})) * 100.0 / count(*), 2) as null_pct from dirty_events"""))
def _(t):
    return profile.null_table(t.dirty_events)


@query("distinct_counts", _union("select '{n}' as \"column\", count(distinct {n}) as \"distinct\" from dirty_events"))
def _(t):
    return profile.distinct_counts(t.dirty_events)


# Values that differ in the twentieth digit after the point only, where doubles would fall together
_DECIMALS = """with d as (select l_orderkey, l_linenumber,
    cast(case when l_linenumber < 7 then cast(l_partkey % 5 as varchar) || '.0000000000000000000' || cast(l_linenumber as varchar) end as decimal(38,20)) as fine,
    cast(l_quantity as decimal(12,2)) as coarse from lineitem)"""


def _decimals(t):
    text = F.concat((c("l_partkey") % 5).cast("string"), F.lit(".0000000000000000000"), c("l_linenumber").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(c("l_linenumber") < 7, text).cast("decimal(38,20)").alias("fine"),
        c("l_quantity").cast("decimal(12,2)").alias("coarse"),
    )


@query("distinct_decimals", _DECIMALS + """
    select 'fine' as "column", count(distinct fine) as "distinct" from d union all select 'coarse', count(distinct coarse) from d""")
def _(t):
    return profile.distinct_counts(_decimals(t).select("fine", "coarse"))


@query("impute_mode_decimals", _DECIMALS + """
    , m as (select fine as v from d where fine is not null group by 1 order by count(*) desc, fine limit 1)
    select l_orderkey, l_linenumber, cast(coalesce(fine, v) as varchar) as fine from d, m""")
def _(t):
    filled = impute.impute(_decimals(t), ["fine"], "mode")
    return filled.select("l_orderkey", "l_linenumber", c("fine").cast("string").alias("fine"))


@query("skewness", " union all ".join(f"""
    select '{n}' as "column", round({sql_skew(n)}, 6) as skewness,
      case when abs({sql_skew(n)}) < 0.15 then 'symmetric' when abs({sql_skew(n)}) < 1 then 'moderate ' else 'strong ' end
        || case when abs({sql_skew(n)}) < 0.15 then '' when {sql_skew(n)} > 0 then 'right' else 'left' end as label,
      case when abs({sql_skew(n)}) < 0.15 then 'symmetric' when abs({sql_skew(n)}) < 0.5 then 'slight'
        when abs({sql_skew(n)}) < 1 then 'moderate' else 'strong' end as grade from dirty_events"""
    for n in ("event_id", "user_id", "value")))
def _(t):
    return profile.skewness_table(t.dirty_events)


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("skewness_labels_five_way", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case when abs(x) < 0.15 then 'symmetric' when abs(x) < 1 then 'moderate ' || case when x > 0 then 'right' else 'left' end
        else 'strong ' || case when x > 0 then 'right' else 'left' end end as label
    from (select *, (l_quantity - 25) / 12 as x from lineitem)""")
def _(t):
    x = (c("l_quantity") - 25) / 12
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", profile.skewness_label(x).alias("label"))


@query("skewness_labels_four_way", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case when abs(x) < 0.15 then 'symmetric' when abs(x) < 0.5 then 'slight' when abs(x) < 1 then 'moderate' else 'strong' end as grade
    from (select *, (l_quantity - 25) / 12 as x from lineitem)""")
def _(t):
    x = (c("l_quantity") - 25) / 12
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", profile.skewness_grade(x).alias("grade"))


def _diagnosis_sql(n, kind, numeric):
    skew = f"round_even({sql_skew(n)}, 3)" if numeric else "cast(null as double)"
    label = f"""case when abs({sql_skew(n)}) < 0.15 then 'symmetric' when abs({sql_skew(n)}) < 1 then 'moderate ' else 'strong ' end
        || case when abs({sql_skew(n)}) < 0.15 then '' when {sql_skew(n)} > 0 then 'right' else 'left' end""" if numeric else "''"
    return f"""
    select '{n}' as "column", '{kind}' as type, count(*) - count({n}) as nulls,
      round_even((count(*) - count({n})) * 100.0 / count(*), 2) as null_pct, count(distinct {n}) as "distinct",
      {skew} as skewness, {label} as label from dirty_events"""


@query("diagnosis", " union all ".join(
    _diagnosis_sql(n, k, k in ("bigint", "double"))
    for n, k in zip(_ALL, ("bigint", "timestamp_ntz", "bigint", "string", "double"))))
def _(t):
    return profile.diagnosis(t.dirty_events)


def _profile_sql(n, table, factor=1.5):
    lo = f"(select quantile_cont({n}, 0.25) - {factor} * (quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25)) from {table})"
    hi = f"(select quantile_cont({n}, 0.75) + {factor} * (quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25)) from {table})"
    return f"""
    select '{n}' as "column", count(*) - count({n}) as nulls, count({n}) as present, cast(min({n}) as double) as min, cast(max({n}) as double) as max,
      round(avg({n}), 6) as mean, round(median({n}), 6) as median, round(stddev_samp({n}), 6) as std,
      round(kurtosis({n}), 6) as kurtosis, round({sql_skew(n)}, 6) as skewness,
      count(*) filter ({n} < {lo} or {n} > {hi}) as outliers from {table}"""


@query("numeric_profile", " union all ".join(_profile_sql(n, "dirty_events") for n in ("event_id", "user_id", "value")))
def _(t):
    return profile.numeric_profile(t.dirty_events)


@query("numeric_profile_lineitem", " union all ".join(_profile_sql(n, "lineitem") for n in _LINE))
def _(t):
    return profile.numeric_profile(t.lineitem, list(_LINE))


@query("sample_kurtosis", """
    select l_returnflag, l_linestatus, round(kurtosis(l_extendedprice), 6) as kurtosis, round(kurtosis(l_discount), 6) as discount_kurtosis
    from lineitem group by all""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        profile.sample_kurtosis(F.kurtosis("l_extendedprice"), F.count("l_extendedprice")).alias("kurtosis"),
        profile.sample_kurtosis(F.kurtosis("l_discount"), F.count("l_discount")).alias("discount_kurtosis"),
    )


@query("date_profile", """
    select 'ts' as "column", min(ts) as min, max(ts) as max from dirty_events""")
def _(t):
    return profile.date_profile(t.dirty_events, ["ts"])


def _top_sql(n, table, k=4):
    return f"""
    (select '{n}' as "column", cast(row_number() over (order by count(*) desc, {n}) as integer) as rank, {n} as value, count(*) as rows,
      cast(round_even(count(*) * 100.0 / sum(count(*)) over (), 0) as integer) as pct
    from {table} where {n} is not null group by {n} order by count(*) desc, {n} limit {k})"""


@query("top_four_values", _top_sql("event_type", "dirty_events"))
def _(t):
    return profile.category_profile(t.dirty_events, ["event_type"])


@query("top_four_values_customer", " union all ".join(_top_sql(n, "dirty_customer") for n in ("active", "c_mktsegment", "name")))
def _(t):
    return profile.category_profile(t.dirty_customer, ["active", "c_mktsegment", "name"])


def _entropy_sql(n, table):
    return f"""
    select '{n}' as "column", count(*) as "distinct", round(-sum(p * log2(p)), 6) as entropy
    from (select count(*) / sum(count(*)) over () as p from {table} where {n} is not null group by {n})"""


@query("entropy", " union all ".join(_entropy_sql(n, "dirty_customer") for n in ("active", "c_mktsegment", "name", "balance")))
def _(t):
    return profile.entropy_table(t.dirty_customer, ["active", "c_mktsegment", "name", "balance"])


def _pattern_sql(n):
    return f"""
    select '{n}' as "column", n as nulls, case when n = 0 then '' when n = total then 'whole column empty'
      when last = n - 1 then 'nulls at the start' when first = total - n then 'nulls at the end'
      when last - first + 1 = n and n >= 3 then 'nulls in one block' else 'nulls scattered' end as pattern
    from (select count(*) as total, count(*) filter ({n} is null) as n, min(case when {n} is null then pos end) as first,
      max(case when {n} is null then pos end) as last from placed)"""


_PATTERNED = """
    with placed as (select *, row_number() over (order by ts) - 1 as pos,
      case when event_id > 40 then user_id end as late, case when event_id < 9000 then user_id end as early,
      case when event_id not between 500 and 700 then event_id end as block, cast(null as bigint) as empty from dirty_events)
    """


@query("null_patterns", _PATTERNED + " union all ".join(_pattern_sql(n) for n in ("late", "early", "block", "empty", "value", "user_id")))
def _(t):
    df = t.dirty_events.withColumns({
        "late": F.when(c("event_id") > 40, c("user_id")), "early": F.when(c("event_id") < 9000, c("user_id")),
        "block": F.when(~c("event_id").between(500, 700), c("event_id")), "empty": F.lit(None).cast("long"),
    })
    return profile.null_patterns(df, ["late", "early", "block", "empty", "value", "user_id"], ["ts"])


@query("quality_score", f"""
    select round(({' + '.join(f'count({n})' for n in _ALL)}) * 100.0 / (count(*) * 5), 6) as quality from dirty_events""")
def _(t):
    return profile.quality(t.dirty_events)


@query("completeness", " union all ".join(f"""
    select '{n}' as "column", round(pct, 6) as complete_pct, case when pct >= 99.95 then 'full' when pct >= 70 then 'good' else 'low' end as band
    from (select count({n}) * 100.0 / count(*) as pct from dirty_events)""" for n in _ALL))
def _(t):
    return profile.completeness(t.dirty_events)


@query("common_values", """
    select value, count(*) as rows from (
      select name as value from dirty_customer union all select active from dirty_customer union all
      select balance from dirty_customer union all select c_mktsegment from dirty_customer)
    where value is not null group by value order by rows desc, value limit 300""")
def _(t):
    return frequency.common_values(t.dirty_customer, ["name", "active", "balance", "c_mktsegment"])


@query("common_values_one_column", """
    select cast(user_id as varchar) as value, count(*) as rows from events group by 1 order by rows desc, value limit 300""")
def _(t):
    return frequency.common_values(t.events, ["user_id"])


_EVENT_KINDS = {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "categorical", "value": "numeric"}


def _full_sql():
    parts = []
    for n, k in _EVENT_KINDS.items():
        numeric = k == "numeric"
        p = _profile_sql(n, "dirty_events").replace("count(*) - count(" + n + ") as nulls, count(" + n + ") as present,", "") if numeric else None
        base = f"""select '{n}' as "column", '{k}' as kind, count(*) - count({n}) as nulls, count(*) as total, count(distinct {n}) as "distinct" from dirty_events"""
        measures = f"({p})" if numeric else f"""(select '{n}' as "column", cast(null as double) as min, cast(null as double) as max,
          cast(null as double) as mean, cast(null as double) as median, cast(null as double) as std, cast(null as double) as kurtosis,
          cast(null as double) as skewness, cast(null as bigint) as outliers)"""
        ends = ["(select min(ts) from dirty_events)", "(select max(ts) from dirty_events)"] if k == "date" else ["cast(null as timestamp)"] * 2
        entropy = f"(select entropy from ({_entropy_sql(n, 'dirty_events')}))" if k == "categorical" else "cast(null as double)"
        top = f"(select string_agg(value || ' ' || pct || '%', '; ' order by rank) from {_top_sql(n, 'dirty_events')})" if k == "categorical" else "cast(null as varchar)"
        pattern = f"(select pattern from ({_pattern_sql(n).replace('from placed', 'from (select *, row_number() over (order by ts) - 1 as pos from dirty_events)')}))"
        parts.append(f"""
        select b.*, {pattern} as pattern, m.min, m.max, m.mean, m.median, m.std, m.kurtosis, m.skewness, m.outliers,
          {ends[0]} as first_date, {ends[1]} as last_date, {entropy} as entropy, {top} as top
        from ({base}) b join {measures} m using ("column")""")
    return " union all ".join(parts)


@query("full_profile", _full_sql())
def _(t):
    return profile.full_profile(t.dirty_events, _EVENT_KINDS, order_by=["ts"])


_LIST = f"""
    with p as ({_full_sql()})
    select "column", kind, nulls, coalesce(outliers, 0) as outliers from p where {{}}"""


def _listed(t, **options):
    found = profile.list_columns(profile.full_profile(t.dirty_events, _EVENT_KINDS), **options)
    return found.select("column", "kind", "nulls", F.coalesce("outliers", F.lit(0)).alias("outliers"))


@query("list_problem_columns", _LIST.format("nulls > 0 or outliers > 0"))
def _(t):
    return _listed(t, show="problems")


@query("list_numeric_columns", _LIST.format("kind = 'numeric' and \"column\" like '%id%'"))
def _(t):
    return _listed(t, show="numeric", search="ID", order="kind")
