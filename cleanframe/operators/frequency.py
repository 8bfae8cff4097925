"""Value frequencies of many columns from one shuffle.

Every row becomes ``(column, value)`` pairs that are counted before the shuffle, so a
value filling a third of the table costs one record per task. Distinct counts, modes,
most frequent values and entropy are all read from this table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_text as text_of
from ..schema import dtype_of, is_integral, is_numeric, quoted

def _home(dtype: T.DataType, as_text: bool) -> tuple[str, str]:
    """Field and type that hold a column's values, so that ties go to the smallest by type.

    Decimals have a field for each scale, with all digits.
    """
    if not as_text and is_integral(dtype):
        return "whole", "long"
    if not as_text and isinstance(dtype, T.DecimalType):
        return f"exact{dtype.scale}", f"decimal(38,{dtype.scale})"
    if not as_text and is_numeric(dtype):
        return "number", "double"
    return "text", "string"


def _value_fields(frequency: DataFrame) -> list[str]:
    return [n for n in frequency.columns if n not in ("column", "rows", "rank")]


def countable(df: DataFrame, name: str) -> bool:
    return not isinstance(dtype_of(df, name), (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def value_frequency(df: DataFrame, columns: list[str], as_text: bool = False) -> DataFrame:
    """Rows ``(column, <typed fields>, rows)``: how often each non-null value occurs.

    A value sits in the field of its type: ``whole``, ``exact<scale>``, ``number``, ``text``.
    """
    homes = {n: _home(dtype_of(df, n), as_text) for n in columns}
    types = {"whole": "long", "number": "double", "text": "string", **dict(homes.values())}

    def pair(name: str) -> Column:
        c, dtype, (home, to) = quoted(name), dtype_of(df, name), homes[name]
        value = text_of(c, dtype) if home == "text" else c.cast(to)
        return F.struct(
            F.lit(name).alias("column"), *[(value if f == home else F.lit(None).cast(t)).alias(f) for f, t in types.items()]
        )

    pairs = df.select(F.inline(F.array(*[pair(n) for n in columns])))
    present = pairs.where(reduce(or_, [F.col(f).isNotNull() for f in types]))
    return present.groupBy("column", *types).agg(F.count(F.lit(1)).alias("rows"))


def ranked(frequency: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column with ``rank``; ties go to the smallest value.

    The rank filter is applied inside each task first, so a column with very many
    distinct values never sits in one task.
    """
    w = Window.partitionBy("column").orderBy(F.col("rows").desc(), *_value_fields(frequency))
    return frequency.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary(frequency: DataFrame) -> DataFrame:
    """Per column: non-null rows, distinct values, entropy in bits.

    ``-sum(p log2 p)`` with ``p = c/n`` equals ``log2 n - sum(c log2 c)/n``, which needs
    no second pass for ``n``.
    """
    totals = frequency.groupBy("column").agg(
        F.sum("rows").alias("present"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.col("rows") * F.log2("rows")).alias("weighted"),
    )
    entropy = F.log2("present") - F.col("weighted") / F.col("present")
    return totals.select("column", "present", "distinct", F.greatest(entropy, F.lit(0.0)).alias("entropy"))


def modes(df: DataFrame, columns: list[str]) -> dict[str, tuple[object, int]]:
    """Most frequent value per column with its count (ties: smallest), as driver values."""
    if not columns:
        return {}
    top = ranked(value_frequency(df, columns), 1)
    fields = _value_fields(top)
    return {r["column"]: (next((r[f] for f in fields if r[f] is not None), None), r["rows"]) for r in top.collect()}


def common_values(df: DataFrame, columns: list[str] | None = None, limit: int = 300) -> DataFrame:
    """Values of one or several columns as text, most frequent first (a top-k report)."""
    names = [n for n in (columns or df.columns) if countable(df, n)]
    values = df.select(F.explode(F.array(*[text_of(quoted(n), dtype_of(df, n)) for n in names])).alias("value"))
    counts = values.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("rows").desc(), "value").limit(limit)
