"""Registered queries: a Spark form over the given tables, and its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.schema import quoted

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Dirty data made from the given tables by text that Spark and DuckDB both run.
VIEWS = {
    "dirty_events": """
        select event_id, ts, user_id,
          case when event_id % 11 = 0 then null else event_type end as event_type,
          case when event_id % 7 < 2 or event_id between 2000 and 2600 then null
               when event_id % 97 = 5 then value * 50 else value end as value
        from events""",
    "dirty_customer": """
        select c_custkey,
          case when c_custkey % 13 = 0 then 'N/A' when c_custkey % 17 = 0 then ' - '
               when c_custkey % 3 = 0 then concat('  ', lower(c_name), '   José  ')
               else upper(c_name) end as name,
          c_nationkey,
          case when c_custkey % 19 = 0 then 'null' when c_custkey % 23 = 0 then 'abc'
               else concat(case when c_acctbal < 0 then '-' else '' end, 'R$ ',
                 cast(cast(floor(abs(round(c_acctbal*100)) / 100) as bigint) as varchar(20)), ',',
                 lpad(cast(cast(abs(round(c_acctbal*100)) as bigint) % 100 as varchar(2)), 2, '0'))
               end as balance,
          case c_custkey % 5 when 0 then 'Sim' when 1 then 'não' when 2 then ' S '
               when 3 then 'N' else '?' end as active,
          c_mktsegment
        from customer""",
    "dup_orders": """
        select * from orders union all select * from orders where o_orderkey % 10 = 0""",
    "text_dates": """
        select o_orderkey,
          case when o_orderkey % 29 = 0 then 'x'
               when o_orderkey % 2 = 0 then concat(
                 lpad(cast(day(o_orderdate) as varchar(2)),2,'0'), '/',
                 lpad(cast(month(o_orderdate) as varchar(2)),2,'0'), '/',
                 cast(year(o_orderdate) as varchar(4)))
               else concat(cast(year(o_orderdate) as varchar(4)), '-',
                 lpad(cast(month(o_orderdate) as varchar(2)),2,'0'), '-',
                 lpad(cast(day(o_orderdate) as varchar(2)),2,'0')) end as order_date
        from orders""",
}

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


class Tables:
    """The tables of one folder, and the dirty views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            base = next(t for t in TABLES if f"from {t}" in VIEWS[name])
            text = VIEWS[name].replace(f"from {base}", f"from {{{base}}}")
            return self.spark.sql(text, **{base: getattr(self, base)})
        raise AttributeError(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums run in another order elsewhere."""
    changes = {f.name: F.round(quoted(f.name), digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(changes) if changes else df


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB form over the same tables."""

    def register(function: Callable[[Tables], DataFrame]):
        _queries[name] = lambda spark, folder: rounded(function(Tables(spark, folder)))
        if sql is not None:
            _oracles[name] = with_views(sql)
        return function

    return register


def with_views(sql: str) -> str:
    """Prefix the dirty views a statement uses."""
    used = [f"{name} as ({text})" for name, text in VIEWS.items() if name in sql]
    body = sql.strip()
    if not used:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(used) + ",\n" + body[5:]
    return "with " + ",\n".join(used) + "\n" + body


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    return dict(_oracles)


# --- SQL fragments -----------------------------------------------------------------------

SQL_NULLS = "('', 'na', 'n/a', 'nan', 'null', 'none', '-', '?', 'sem dado')"


def sql_clean(c: str) -> str:
    """Stripped, spaces collapsed, null spellings as null."""
    return f"case when lower(trim({c})) not in {SQL_NULLS} then regexp_replace(trim({c}), '\\s+', ' ', 'g') end"


def sql_number(c: str, comma: bool = True) -> str:
    s = f"regexp_replace({c}, '[R$%\\s]', '', 'g')"
    if comma:
        s = f"replace(replace({s}, '.', ''), ',', '.')"
    return f"case when regexp_matches({s}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') then try_cast({s} as double) end"


def sql_boolean(c: str) -> str:
    return (
        f"case when lower(trim({c})) in ('true','verdadeiro','sim','s','1','yes') then true "
        f"when lower(trim({c})) in ('false','falso','não','nao','n','0','no') then false end"
    )


def sql_date(c: str) -> str:
    return f"try_strptime({c}, ['%d/%m/%Y', '%Y-%m-%d', '%m/%d/%Y'])"


def sql_skew(c: str) -> str:
    return (
        f"case when count({c}) >= 2 and stddev_samp({c}) <> 0 "
        f"then 3 * (avg({c}) - median({c})) / stddev_samp({c}) else 0 end"
    )


def sql_title(c: str) -> str:
    words = f"regexp_extract_all({c}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+')"
    return f"array_to_string(list_transform({words}, lambda w: case when w[1] = 'ß' then 'Ss' else upper(w[1]) end || lower(w[2:])), '')"
