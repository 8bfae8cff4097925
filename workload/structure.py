"""Sources, sinks, columns, types, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.functions import booleans, dates, numbers, text
from cleanframe.operators import columns, kinds, order
from cleanframe.operators.text import standardise_text
from cleanframe.session import scratch_path
from cleanframe.sources import readers, writers

from .registry import (
    SQL_NULLS, query, sql_boolean, sql_clean, sql_date, sql_number, sql_title,
)

c = F.col


# --- sources and sinks ---------------------------------------------------------------------

def _written_csv(t, df, sep=","):
    path = scratch_path(t.spark, "csv")
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("csv_scan", """
    select cast(c_custkey as varchar) as c_custkey, case when c_custkey % 13 <> 0 then c_name end as c_name,
      c_mktsegment from customer""")
def _(t):
    named = t.customer.select(
        "c_custkey", F.when(c("c_custkey") % 13 == 0, "NA").otherwise(c("c_name")).alias("c_name"), "c_mktsegment"
    )
    return readers.read_csv(t.spark, _written_csv(t, named, ";"))


@query("tsv_scan", "select cast(s_suppkey as varchar) as s_suppkey, s_name from supplier")
def _(t):
    return readers.read_csv(t.spark, _written_csv(t, t.supplier.select("s_suppkey", "s_name"), "\t"), sep="\t")


@query("csv_typed_scan", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal from customer")
def _(t):
    path = _written_csv(t, t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    return readers.read_csv(t.spark, path, typed=True)


@query("json_scan_flatten", """
    select o_orderkey as "id", o_custkey as "buyer.key", o_orderstatus as "state.code.value",
      o_orderpriority as "state.priority" from orders""")
def _(t):
    path = scratch_path(t.spark, "json")
    nested = t.orders.select(
        c("o_orderkey").alias("id"),
        F.struct(c("o_custkey").alias("key")).alias("buyer"),
        F.struct(F.struct(c("o_orderstatus").alias("value")).alias("code"), c("o_orderpriority").alias("priority")).alias("state"),
    )
    nested.write.json(path)
    return readers.read_file(t.spark, path, file_format="json")


@query("json_several_lines", """
    select o_orderkey as "id", o_custkey as "buyer.key", o_orderpriority || chr(34) || ' } {' as note,
      cast(null as varchar) as bad_record from orders
    union all select null, null, null, '{"id": 1, "bu' from region""")
def _(t):
    """Records of five lines each, lines of one record and broken lines, each kind in its own files."""
    path = scratch_path(t.spark, "json")
    record = F.to_json(F.struct(
        c("o_orderkey").alias("id"), F.struct(c("o_custkey").alias("key")).alias("buyer"),
        F.concat("o_orderpriority", F.lit('" } {')).alias("note")))
    several = F.regexp_replace(F.regexp_replace(record, r"^\{", "{\n "), r'\}$', "\n}")
    t.orders.where("o_orderkey % 2 = 0").select(F.regexp_replace(several, r',"(buyer|note)"', ',\n "$1"')).write.text(path)
    broken = t.region.select(F.lit('{"id": 1, "bu'))
    t.orders.where("o_orderkey % 2 = 1").select(record).union(broken).coalesce(1).write.mode("append").text(path)
    return readers.read_json(t.spark, path)


@query("csv_quoted_breaks", """
    select cast(c_custkey as varchar) as c_custkey, case when c_custkey % 2 = 0 then c_name || chr(10) || '"não";' else c_name || ' é' end as note
    from customer""")
def _(t):
    """Quoted line breaks in some files, Latin-1 in others."""
    path = scratch_path(t.spark, "csv")
    breaks = F.when(c("c_custkey") % 2 == 0, F.concat("c_name", F.lit('\n"não";'))).otherwise(F.concat("c_name", F.lit(" é")))
    rows = t.customer.select("c_custkey", breaks.alias("note"))
    for rest, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        rows.where(c("c_custkey") % 2 == rest).write.mode("append").option("header", True).option("sep", ";") \
            .option("escape", '"').option("encoding", encoding).csv(path)
    return readers.read_csv(t.spark, path, ";")


@query("parquet_scan", """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
    where l_shipdate >= timestamp '1995-01-01' and l_quantity > 30""")
def _(t):
    df = readers.read_parquet(t.spark, t.path("lineitem"))
    late = df.where("l_shipdate >= timestamp_ntz '1995-01-01' and l_quantity > 30")
    return late.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("separator_detection", """
    select ',' as written, ',' as detected, count(*) as rows from customer union all
    select ';', ';', count(*) from customer union all
    select chr(9), chr(9), count(*) from customer union all
    select '|', '|', count(*) from customer""")
def _(t):
    frames = []
    for sep in (",", ";", "\t", "|"):
        path = _written_csv(t, t.customer.select("c_custkey", "c_name", "c_mktsegment"), sep)
        found = readers.detect_separator(t.spark, path)
        rows = readers.read_csv(t.spark, path, found).agg(F.count(F.lit(1)).alias("rows"))
        frames.append(rows.select(F.lit(sep).alias("written"), F.lit(found).alias("detected"), "rows"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query("encoding_check", """
    select 'utf8' as written, count(*) as lines, true as utf8 from customer union all
    select 'latin1', count(*), false from customer""")
def _(t):
    frames = []
    for name, encoding in (("utf8", "UTF-8"), ("latin1", "ISO-8859-1")):
        path = scratch_path(t.spark, "encoded")
        t.dirty_customer.select(F.concat(c("active"), F.lit(" não ")).alias("x")).write.option("encoding", encoding).csv(path)
        frames.append(readers.is_utf8(t.spark, path).select(F.lit(name).alias("written"), "lines", "utf8"))
    return frames[0].unionByName(frames[1])


@query("source_row_id", "select row_number() over () - 1 as row_id, o_orderkey, o_custkey from orders")
def _(t):
    return readers.read_parquet(t.spark, t.path("orders"), row_id="row_id").select("row_id", "o_orderkey", "o_custkey")


@query("text_source_row_id", """
    select row_number() over (order by event_id) - 1 as row_id, cast(event_id as varchar) as event_id from events""")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.events.select("event_id").repartitionByRange(4, "event_id").sortWithinPartitions("event_id") \
        .write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, ",", row_id="row_id")


@query("dense_position", "select event_id, row_number() over (order by ts) - 1 as position from events")
def _(t):
    return order.with_position(t.events.select("event_id", "ts"), ["ts"]).select("event_id", "position")


@query("csv_write", "select cast(event_id as varchar) as event_id, event_type from dirty_events")
def _(t):
    path = scratch_path(t.spark, "out")
    writers.write_csv(t.dirty_events.select("event_id", "event_type"), path, sep=";")
    return readers.read_csv(t.spark, path, ";")


@query("json_write", "select event_id, event_type, round(value, 6) as value, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from dirty_events")
def _(t):
    path = scratch_path(t.spark, "out")
    seconds = F.date_trunc("second", "ts").cast("timestamp_ntz")
    writers.write_json(t.dirty_events.select("event_id", "event_type", "value", seconds.alias("ts")), path)
    back = t.spark.read.schema("event_id long, event_type string, value double, ts string").json(path)
    return back.withColumn("ts", F.substr("ts", F.lit(1), F.lit(19)))


# --- columns -----------------------------------------------------------------------------

@query("drop_columns", "select o_orderkey, o_custkey, o_orderdate from orders")
def _(t):
    return columns.drop_columns(t.orders, ["o_orderstatus", "o_totalprice", "o_orderpriority", "missing"])


@query("rename_columns", """
    select n_nationkey as nation, n_name, n_regionkey from nation""")
def _(t):
    return columns.rename_columns(t.nation, {"n_nationkey": "nation", "n_name": "", "n_regionkey": "n_regionkey"})


@query("snake_case_names", """
    select c_custkey as customer_key, c_name as nome_completo, c_nationkey as nation_key,
      c_acctbal as nation_key_2, c_mktsegment as seg_mento from customer""")
def _(t):
    messy = t.customer.toDF("  Customer Key ", "Nome Completo", "Nation-Key", "nation__key", "Ség%mento_")
    return columns.snake_case_columns(messy)


@query("select_numeric", "select c_custkey, c_nationkey, c_acctbal from customer")
def _(t):
    return columns.select_by_type(t.customer.withColumn("flag", F.lit(True)), "numeric")


@query("select_text", "select c_name, c_mktsegment from customer")
def _(t):
    return columns.select_by_type(t.customer, "text")


# --- types -------------------------------------------------------------------------------

@query("parse_number", f"select c_custkey, round({sql_number('balance')}, 6) as amount from dirty_customer")
def _(t):
    return t.dirty_customer.select("c_custkey", numbers.parse_number(c("balance"), True).alias("amount"))


_TEXTS = ("name", "balance", "active", "c_mktsegment")


def _vote_sql(n):
    v = f"case when lower(trim({n})) not in {SQL_NULLS} then trim({n}) end"
    comma = rf"count(*) filter (regexp_full_match({v}, '-?(R\$)?\s?[\d.]*,\d+%?'))"
    dot = rf"count(*) filter (regexp_full_match({v}, '-?(R\$)?\s?[\d,]*\.\d+%?'))"
    return f"select '{n}' as \"column\", {comma} as comma_hits, {dot} as dot_hits, {comma} > {dot} as decimal_comma from dirty_customer"


@query("detect_decimal_comma", " union all ".join(_vote_sql(n) for n in _TEXTS))
def _(t):
    return kinds.decimal_comma_votes(t.dirty_customer)


def _kind_sql(n, table="dirty_customer"):
    comma = rf"count(*) filter (regexp_full_match(v, '-?(R\$)?\s?[\d.]*,\d+%?')) > count(*) filter (regexp_full_match(v, '-?(R\$)?\s?[\d,]*\.\d+%?'))"
    parsed = f"case when {comma} then count({sql_number('v')}) else count({sql_number('v', False)}) end"
    bools = f"count({sql_boolean('v')})"
    datelike = r"count(*) filter (regexp_matches(v, '\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}'))"
    return f"""
    select '{n}' as "column", case when count(v) = 0 then 'text'
      when {bools} / count(v) >= 0.95 and count(distinct lower(v)) <= 2 then 'boolean'
      when {parsed} / count(v) >= 0.9 then 'numeric'
      when {datelike} / count(v) >= 0.9 and count({sql_date('v')}) / count(v) >= 0.9 then 'date'
      when count(distinct v) / count(v) <= 0.5 or (count(distinct v) <= 20 and count(distinct v) / count(v) < 0.9)
        then 'categorical' else 'text' end as kind
    from (select case when lower(trim({n})) not in {SQL_NULLS} then trim({n}) end as v from {table})"""


@query("infer_kind_of_dates", _kind_sql("order_date", "text_dates") + " union all select 'o_orderkey', 'numeric'")
def _(t):
    return kinds.kinds_frame(t.text_dates)


@query(
    "infer_kinds",
    " union all ".join(_kind_sql(n) for n in _TEXTS)
    + " union all select 'c_custkey', 'numeric' union all select 'c_nationkey', 'numeric'",
)
def _(t):
    return kinds.kinds_frame(t.dirty_customer)


@query("convert_numeric", f"select c_custkey, round({sql_number('balance')}, 6) as balance from dirty_customer")
def _(t):
    df = t.dirty_customer.select("c_custkey", "balance")
    verdict = kinds.detect_decimal_comma(df, ["balance"])
    return kinds.convert_kinds(df, {"c_custkey": "numeric", "balance": "numeric"}, verdict)


@query("convert_date", f"select o_orderkey, {sql_date('order_date')} as order_date from text_dates")
def _(t):
    return t.text_dates.select("o_orderkey", dates.parse_date(c("order_date")).alias("order_date"))


@query("convert_boolean", f"select c_custkey, {sql_boolean('active')} as active from dirty_customer")
def _(t):
    return t.dirty_customer.select("c_custkey", booleans.parse_boolean(c("active")).alias("active"))


@query("convert_text", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_linenumber as varchar) as line_text,
      l_returnflag as flag from lineitem""")
def _(t):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_linenumber").alias("line_text"), c("l_returnflag").alias("flag")
    )
    return kinds.convert_kinds(df, {"line_text": "text", "flag": "categorical"})


@query("convert_integer", f"select c_custkey, cast(round_even({sql_number('balance')}, 0) as bigint) as balance from dirty_customer")
def _(t):
    return kinds.convert_types(t.dirty_customer.select("c_custkey", "balance"), {"balance": "integer"}, decimal_comma=True)


@query("explicit_conversions", f"""
    select c_custkey, {sql_boolean('active')} as active, round({sql_number('balance')}, 6) as balance,
      cast(c_nationkey as varchar) as c_nationkey, c_mktsegment from dirty_customer""")
def _(t):
    return kinds.convert_types(
        t.dirty_customer.drop("name"),
        {"active": "boolean", "balance": "number", "c_nationkey": "text", "c_mktsegment": "category"},
        decimal_comma=True,
    )


@query("explicit_date_format", """
    select o_orderkey, try_strptime(order_date, '%d/%m/%Y') as order_date from text_dates""")
def _(t):
    return kinds.convert_types(t.text_dates, {"order_date": "date"}, date_formats={"order_date": "dd/MM/yyyy"})


@query("invalid_counts", f"""
    select 'balance' as "column", count(*) filter (balance is not null and {sql_number('balance')} is null) as invalid from dirty_customer
    union all
    select 'active', count(*) filter (active is not null and {sql_boolean('active')} is null) from dirty_customer""")
def _(t):
    return kinds.invalid_counts(
        t.dirty_customer,
        {"balance": numbers.parse_number(c("balance"), True), "active": booleans.parse_boolean(c("active"))},
    )


# --- text --------------------------------------------------------------------------------

@query("strip", "select c_custkey, trim(name) as name, trim(active) as active from dirty_customer")
def _(t):
    return t.dirty_customer.select("c_custkey", text.strip(c("name")).alias("name"), text.strip(c("active")).alias("active"))


@query("collapse_spaces", r"select doc_id, md5(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.collapse_spaces(c("text"))).alias("text"))


@query("change_case", f"""
    select c_custkey, lower(name) as lower_name, upper(name) as upper_name, {sql_title('name')} as title_name
    from dirty_customer""")
def _(t):
    return t.dirty_customer.select(
        "c_custkey", *[text.change_case(c("name"), k).alias(f"{k}_name") for k in ("lower", "upper", "title")]
    )


@query("title_case_documents", f"select doc_id, md5({sql_title('text')}) as text from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.title_case(c("text"))).alias("text"))


@query("strip_accents", "select doc_id, md5(strip_accents(text)) as text from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.strip_accents(c("text"))).alias("text"))


@query("strip_accents_latin", "select c_custkey, strip_accents(name) as name from dirty_customer")
def _(t):
    return t.dirty_customer.select("c_custkey", text.strip_accents(c("name"), single_only=True).alias("name"))


@query("remove_special", r"select doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}_\s.,@\-]', '', 'g')) as text from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.remove_special(c("text"))).alias("text"))


@query("null_spellings", f"""
    select c_custkey, case when lower(trim(name)) not in {SQL_NULLS} then name end as name,
      case when lower(trim(balance)) not in {SQL_NULLS} then balance end as balance,
      case when lower(trim(active)) not in {SQL_NULLS} then active end as active from dirty_customer""")
def _(t):
    return t.dirty_customer.select(
        "c_custkey", *[text.null_spellings_to_null(c(n)).alias(n) for n in ("name", "balance", "active")]
    )


def _stepped_sql(n):
    titled = sql_title(rf"regexp_replace(trim({n}), '\s+', ' ', 'g')")
    return rf"regexp_replace(strip_accents({titled}), '[^\p{{L}}\p{{N}}_\s.,@\-]', '', 'g') as {n}"


@query("text_step", f"""
    with stepped as (select c_custkey, {', '.join(_stepped_sql(n) for n in _TEXTS)} from dirty_customer)
    select c_custkey, {', '.join(f"case when lower(trim({n})) not in {SQL_NULLS} then {n} end as {n}" for n in _TEXTS)} from stepped""")
def _(t):
    return standardise_text(
        t.dirty_customer.drop("c_nationkey"), list(_TEXTS), case="title", accents=True, special=True
    )


@query("text_step_default", f"select c_custkey, {', '.join(f'{sql_clean(n)} as {n}' for n in _TEXTS)} from dirty_customer")
def _(t):
    return standardise_text(t.dirty_customer.drop("c_nationkey"), list(_TEXTS))
