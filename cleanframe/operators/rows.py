"""Duplicates, null rows, null columns and filters."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocabulary import COMPARISONS, FALSE_SPELLINGS, FILTER_OPERATORS, TRUE_SPELLINGS, label
from ..functions.dates import date_or_none
from ..functions.numbers import as_text, number_or_none
from ..schema import dtype_of, is_date, is_numeric, quoted
from ..session import small_frame


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Distinct rows; with ``row_id`` the copy with the smallest id is the one kept.

    Both forms aggregate before the shuffle, so a row repeated many times costs one
    record per task.
    """
    if row_id is None:
        return df.dropDuplicates()
    keys = [quoted(n) for n in df.columns if n != row_id]
    kept = df.groupBy(*keys).agg(F.min(quoted(row_id)).alias(row_id))
    return kept.select(*[quoted(n) for n in df.columns])


def drop_duplicates_on(df: DataFrame, subset: list[str], order_by: list, keep: str = "first") -> DataFrame:
    """One row per value of ``subset``: the first or the last by ``order_by``.

    The rank-is-one filter lets Spark cut each key to a single row per task before the
    shuffle, so a hot key never lands whole in one task.
    """
    order = [quoted(o) if isinstance(o, str) else o for o in order_by]
    if keep == "last":
        order = [o.desc_nulls_last() for o in order]
    elif keep != "first":
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    w = Window.partitionBy(*[quoted(n) for n in subset]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def drop_repeated(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop every member of a duplicated group.

    A partial aggregate carries one row and a count per key, not the group.
    """
    subset = subset or df.columns
    rest = [n for n in df.columns if n not in subset]
    measures = [F.count(F.lit(1)).alias("__copies")]
    if rest:
        measures.append(F.first(F.struct(*[quoted(n) for n in rest])).alias("__row"))
    single = df.groupBy(*[quoted(n) for n in subset]).agg(*measures).where("__copies = 1")
    return single.select(
        *[(quoted(n) if n in subset else F.col("__row").getField(n)).alias(n) for n in df.columns]
    )


def drop_null_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Drop rows with a null in any required column."""
    for name in required:
        df = df.where(quoted(name).isNotNull())
    return df


def columns_above_null_share(df: DataFrame, threshold: float) -> list[str]:
    """Columns whose null percentage is strictly above ``threshold``."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(n)).alias(f"n{i}") for i, n in enumerate(df.columns)]).first()
    if not counts["rows"]:
        return []
    return [n for i, n in enumerate(df.columns) if (1 - counts[f"n{i}"] / counts["rows"]) * 100 > threshold]


def drop_null_columns(df: DataFrame, threshold: float) -> DataFrame:
    return df.drop(*[quoted(n) for n in columns_above_null_share(df, threshold)])


def filter_condition(df: DataFrame, rule: dict) -> Column | None:
    """Condition of one filter, never null; None if it cannot apply to the column type."""
    name, op, raw = rule["column"], label(rule["operator"]), rule.get("value", "")
    if op not in FILTER_OPERATORS:
        raise ValueError(f"unknown filter operator: {op!r}")
    c, dtype = quoted(name), dtype_of(df, name)
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    if op in ("contains", "not contains"):
        found = F.coalesce(F.contains(F.lower(as_text(c, dtype)), F.lower(F.lit(str(raw)))), F.lit(False))
        return found if op == "contains" else ~found
    if is_numeric(dtype):
        value = number_or_none(raw)
        if value is None:
            return None
        if isinstance(dtype, T.IntegralType) and value.is_integer() and abs(value) < 2**53:
            value = int(value)
        right = F.lit(value)
    elif isinstance(dtype, T.BooleanType):
        spelled = str(raw).strip().lower()
        if spelled not in TRUE_SPELLINGS + FALSE_SPELLINGS:
            return None
        right = F.lit(spelled in TRUE_SPELLINGS)
    elif is_date(dtype):
        moment = date_or_none(raw)
        if moment is None:
            return None
        right = F.lit(moment).cast("timestamp_ntz").cast(dtype)
    elif isinstance(dtype, T.StringType):
        right = F.lit(str(raw))
    else:
        return None
    return _compare(c, op, right)


def _compare(c: Column, op: str, right: Column) -> Column:
    """Comparison with SQL nulls: a null row passes none of the six."""
    assert op in COMPARISONS
    return {
        "==": c == right, "!=": c != right, ">": c > right,
        ">=": c >= right, "<": c < right, "<=": c <= right,
    }[op]


@dataclass
class Filtered:
    """Outcome of a filter chain, and how to count the rows each filter removed."""

    df: DataFrame
    source: DataFrame
    filters: list[dict]
    conditions: list[Column | None]

    def removed_counts(self) -> DataFrame:
        """Rows ``(filter, column, operator, value, skipped, removed)`` from one aggregate."""
        passed, kept = F.lit(True), []
        for condition in self.conditions:
            if condition is not None:
                passed = passed & F.coalesce(condition, F.lit(False))
            kept.append(passed)
        counts = self.source.agg(
            F.count(F.lit(1)).alias("kept0"), *[F.count_if(k).alias(f"kept{i + 1}") for i, k in enumerate(kept)]
        )
        rows = [
            F.struct(
                F.lit(i + 1).alias("filter"), F.lit(f["column"]).alias("column"),
                F.lit(label(f["operator"])).alias("operator"), F.lit(str(f.get("value", ""))).alias("value"),
                F.lit(self.conditions[i] is None).alias("skipped"),
                (F.col(f"kept{i}") - F.col(f"kept{i + 1}")).alias("removed"),
            )
            for i, f in enumerate(self.filters)
        ]
        if not rows:
            schema = pa.schema([
                ("filter", pa.int32()), ("column", pa.string()), ("operator", pa.string()),
                ("value", pa.string()), ("skipped", pa.bool_()), ("removed", pa.int64()),
            ])
            return small_frame(self.source.sparkSession, [], schema)
        return counts.select(F.inline(F.array(*rows)))


def apply_filters(df: DataFrame, filters: list[dict]) -> Filtered:
    """Conjunction of filters; a value that cannot be compared with the column skips its filter."""
    conditions = [filter_condition(df, f) for f in filters]
    result = df
    for condition in conditions:
        if condition is not None:
            result = result.where(condition)
    return Filtered(result, df, list(filters), conditions)
