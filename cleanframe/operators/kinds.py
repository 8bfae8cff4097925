"""Semantic kind of each column, and conversion to it."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import booleans, dates, numbers
from ..functions.vocabulary import BOOLEAN, CATEGORICAL, DATE, NUMERIC, TEXT, label
from ..schema import dtype_of, is_date, is_integral, is_numeric, quoted, text_columns
from ..session import aggregate_row, small_frame

# Fixed thresholds of the inference rules.
BOOLEAN_SHARE, NUMERIC_SHARE, DATE_SHARE = 0.95, 0.9, 0.9
REPEAT_RATIO, FEW_VALUES, FEW_VALUES_RATIO = 0.5, 20, 0.9


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _locale_votes(columns: list[str]) -> list[Column]:
    votes = []
    for i, name in enumerate(columns):
        value = numbers.clean_value(quoted(name))
        votes += [
            _count(numbers.comma_decimal_hit(value)).alias(f"comma{i}"),
            _count(numbers.dot_decimal_hit(value)).alias(f"dot{i}"),
        ]
    return votes


def decimal_comma_votes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: comma-decimal and dot-decimal matches and the verdict, in one aggregate."""
    columns = text_columns(df) if columns is None else columns
    votes = df.agg(*_locale_votes(columns))
    rows = [
        F.struct(
            F.lit(n).alias("column"), F.col(f"comma{i}").alias("comma_hits"), F.col(f"dot{i}").alias("dot_hits"),
            (F.col(f"comma{i}") > F.col(f"dot{i}")).alias("decimal_comma"),
        )
        for i, n in enumerate(columns)
    ]
    return votes.select(F.inline(F.array(*rows)))


def detect_decimal_comma(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    if not columns:
        return {}
    row = df.agg(*_locale_votes(columns)).first()
    return {n: row[f"comma{i}"] > row[f"dot{i}"] for i, n in enumerate(columns)}


def infer_kinds(
    df: DataFrame, overrides: dict | None = None, sample: float | None = None
) -> tuple[dict[str, str], dict[str, bool]]:
    """Kind of every column and the decimal-comma verdict of the text columns.

    One aggregate reads all text columns. Distinct values are counted only where the
    other rules leave a column open.
    ``sample`` looks at a fraction of the rows instead of all of them.
    """
    overrides = {k: label(v) for k, v in (overrides or {}).items() if k in df.columns}
    kinds: dict[str, str] = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.BooleanType):
            kinds[field.name] = BOOLEAN
        elif is_date(field.dataType):
            kinds[field.name] = DATE
        elif is_numeric(field.dataType):
            kinds[field.name] = NUMERIC
        else:
            kinds[field.name] = TEXT
    texts = text_columns(df)
    if not texts:
        return {**kinds, **overrides}, {}

    looked = df.sample(sample, seed=7) if sample else df
    values = looked.select(*[numbers.clean_value(quoted(n)).alias(f"v{i}") for i, n in enumerate(texts)])
    measures = []
    for i in range(len(texts)):
        v = F.col(f"v{i}")
        measures += [
            F.count(v).alias(f"n{i}"),
            _count(booleans.is_boolean_spelling(v)).alias(f"bool{i}"),
            F.min(F.lower(v)).alias(f"min{i}"),
            F.max(F.lower(v)).alias(f"max{i}"),
            _count(numbers.comma_decimal_hit(v)).alias(f"comma{i}"),
            _count(numbers.dot_decimal_hit(v)).alias(f"dot{i}"),
            F.count(numbers.parse_number(v, True)).alias(f"numcomma{i}"),
            F.count(numbers.parse_number(v, False)).alias(f"numdot{i}"),
            _count(v.rlike(dates.DATE_LIKE)).alias(f"datelike{i}"),
            # Whatever parses as a date also looks like one
            F.count(F.when(v.rlike(dates.DATE_LIKE), dates.parse_date(v))).alias(f"date{i}"),
        ]
    seen = aggregate_row(values, measures)
    comma = {name: seen[f"comma{i}"] > seen[f"dot{i}"] for i, name in enumerate(texts)}

    # At most two distinct values: every value is the smallest or the largest one
    candidates = [i for i in range(len(texts)) if seen[f"n{i}"] and seen[f"bool{i}"] / seen[f"n{i}"] >= BOOLEAN_SHARE]
    others = {}
    if candidates:
        others = values.agg(
            *[
                _count(~F.lower(F.col(f"v{i}")).isin(seen[f"min{i}"], seen[f"max{i}"])).alias(f"other{i}")
                for i in candidates
            ]
        ).first().asDict()

    open_columns = []
    for i, name in enumerate(texts):
        n = seen[f"n{i}"]
        parsed = seen[f"numcomma{i}"] if comma[name] else seen[f"numdot{i}"]
        if n == 0:
            kinds[name] = TEXT
        elif others.get(f"other{i}") == 0:
            kinds[name] = BOOLEAN
        elif parsed / n >= NUMERIC_SHARE:
            kinds[name] = NUMERIC
        elif seen[f"datelike{i}"] / n >= DATE_SHARE and seen[f"date{i}"] / n >= DATE_SHARE:
            kinds[name] = DATE
        elif name not in overrides:
            open_columns.append(i)
    for i, kind in _repeat_kinds(values, open_columns, {i: seen[f"n{i}"] for i in open_columns}).items():
        kinds[texts[i]] = kind
    return {**kinds, **overrides}, comma


def _repeat_kinds(values: DataFrame, indexes: list[int], counts: dict[int, int]) -> dict[int, str]:
    """Categorical or text, by how often values repeat."""
    kinds = {}
    for i, distinct in _distinct_values(values, indexes).items():
        ratio = distinct / counts[i]
        repeats = ratio <= REPEAT_RATIO or (distinct <= FEW_VALUES and ratio < FEW_VALUES_RATIO)
        kinds[i] = CATEGORICAL if repeats else TEXT
    return kinds


def _distinct_values(values: DataFrame, indexes: list[int]) -> dict[int, int]:
    """Distinct values per column, counted on two 64-bit hashes so that no long text is shuffled."""
    if not indexes:
        return {}
    hashed = []
    for i in indexes:
        v = F.col(f"v{i}")
        hashed.append(F.struct(F.lit(i).alias("i"), F.when(v.isNotNull(), F.xxhash64(v)).alias("a"), F.xxhash64(F.lit(1), v).alias("b")))
    pairs = values.select(F.inline(F.array(*hashed))).where("a is not null")
    counted = pairs.distinct().groupBy("i").count()
    return {r["i"]: r["count"] for r in counted.collect()}


def kinds_frame(df: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Inferred kinds as rows ``(column, kind)``."""
    kinds, _ = infer_kinds(df, overrides)
    rows = [{"column": c, "kind": k} for c, k in kinds.items()]
    return small_frame(df.sparkSession, rows, pa.schema([("column", pa.string()), ("kind", pa.string())]))


def convert(c: Column, dtype: T.DataType, kind: str, decimal_comma: bool = False) -> Column:
    """Column converted to a semantic kind; values that do not fit become null."""
    kind = label(kind)
    if kind == NUMERIC:
        if is_numeric(dtype):
            return c
        if isinstance(dtype, T.BooleanType):
            return c.cast("double")
        if is_date(dtype):
            epoch = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz")
            return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz")).cast("double") * 1000
        return numbers.parse_number(c.cast("string"), decimal_comma)
    if kind == DATE:
        if isinstance(dtype, T.TimestampNTZType):
            return c
        if is_date(dtype):
            return c.cast("timestamp_ntz")
        return dates.parse_date(c.cast("string"))
    if kind == BOOLEAN:
        return c if isinstance(dtype, T.BooleanType) else booleans.parse_boolean(c)
    if kind in (TEXT, CATEGORICAL):
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            return c
        return numbers.as_text(c, dtype)
    raise ValueError(f"unknown kind: {kind!r}")


def convert_kinds(df: DataFrame, kinds: dict[str, str], decimal_comma: dict[str, bool] | None = None) -> DataFrame:
    """Convert every listed column in one projection."""
    decimal_comma = decimal_comma or {}
    changes = {
        n: convert(quoted(n), dtype_of(df, n), k, decimal_comma.get(n, False)) for n, k in kinds.items() if n in df.columns
    }
    return df.withColumns(changes) if changes else df


def convert_type(
    c: Column, dtype: T.DataType, target: str, decimal_comma: bool = False,
    day_first: bool = True, date_format: str | None = None,
) -> Column:
    """Column converted to an explicit target: number, integer, date, text, category or boolean."""
    target = label(target)
    if target in ("number", NUMERIC):
        return convert(c, dtype, NUMERIC, decimal_comma)
    if target == "integer":
        if is_integral(dtype):
            return c.cast("long")
        return numbers.round_half_even(convert(c, dtype, NUMERIC, decimal_comma)).try_cast("long")
    if target == DATE:
        if is_date(dtype):
            return convert(c, dtype, DATE)
        if date_format:
            return dates.parse_date_format(c.cast("string"), date_format)
        return dates.parse_date(c.cast("string"), day_first)
    if target in (TEXT, "category", CATEGORICAL):
        return convert(c, dtype, TEXT)
    if target == BOOLEAN:
        return convert(c, dtype, BOOLEAN)
    raise ValueError(f"unknown conversion: {target!r}")


def convert_types(
    df: DataFrame, conversions: dict[str, str], decimal_comma: bool = False,
    day_first: bool = True, date_formats: dict[str, str] | None = None,
) -> DataFrame:
    """Explicit conversions, one locale for all columns."""
    formats = date_formats or {}
    changes = {
        n: convert_type(quoted(n), dtype_of(df, n), t, decimal_comma, day_first, formats.get(n))
        for n, t in conversions.items()
    }
    return df.withColumns(changes) if changes else df


def invalid_counts(df: DataFrame, converted: dict[str, Column]) -> DataFrame:
    """Per column: values that were present and became null, in one aggregate."""
    if not converted:
        return small_frame(df.sparkSession, [], pa.schema([("column", pa.string()), ("invalid", pa.int64())]))
    lost = df.agg(
        *[_count(quoted(n).isNotNull() & c.isNull()).alias(f"lost{i}") for i, (n, c) in enumerate(converted.items())]
    )
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"lost{i}").alias("invalid")) for i, n in enumerate(converted)]
    return lost.select(F.inline(F.array(*rows)))
