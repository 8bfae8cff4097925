"""Outlier bounds and what to do with values outside them."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import round_half_even
from ..functions.vocabulary import OUTLIER_ACTIONS, label
from ..schema import dtype_of, is_integral, quoted
from ..session import small_frame
from .profile import numeric_stats, outlier_counts

Bounds = dict[str, tuple[float | None, float | None]]


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "IQR", factor: float = 1.5) -> Bounds:
    """Bounds of all columns; columns without values have none."""
    if method.upper() == "IQR":
        stats = numeric_stats(df, columns, [0.25, 0.75])
        return {n: s.iqr_bounds(factor) if s.n else (None, None) for n, s in stats.items()}
    stats = numeric_stats(df, columns, [])
    return {n: s.z_bounds(factor) if s.n else (None, None) for n, s in stats.items()}


def bounds_frame(df: DataFrame, columns: list[str], method: str = "IQR", factor: float = 1.5) -> DataFrame:
    """Rows ``(column, low, high, outliers)``."""
    bounds = outlier_bounds(df, columns, method, factor)
    counts = outlier_counts(df, bounds)
    rows = [{"column": n, "low": b[0], "high": b[1], "outliers": counts[n]} for n, b in bounds.items()]
    schema = pa.schema([("column", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("outliers", pa.int64())])
    return small_frame(df.sparkSession, rows, schema)


def is_outlier(c: Column, low: float | None, high: float | None) -> Column:
    """Strictly outside the bounds; null and unbounded columns are never outliers."""
    if low is None or high is None:
        return F.lit(False)
    return F.coalesce((c < F.lit(float(low))) | (c > F.lit(float(high))), F.lit(False))


def clip(c: Column, dtype: T.DataType, low: float | None, high: float | None) -> Column:
    """Value limited to the bounds; integers are rounded half to even, nulls stay."""
    if low is None or high is None:
        return c
    limited = F.when(c.isNotNull(), F.greatest(F.least(c.cast("double"), F.lit(float(high))), F.lit(float(low))))
    if is_integral(dtype):
        # A value inside the bounds keeps its full integer precision
        return F.when(is_outlier(c, low, high), round_half_even(limited).cast(dtype)).otherwise(c)
    return limited.cast(dtype)


def flag_outliers(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Add a boolean column ``<name>_outlier`` per bounded column."""
    return df.withColumns({f"{n}_outlier": is_outlier(quoted(n), *b) for n, b in bounds.items()})


def removal(bounds: Bounds) -> Column:
    """True where any bounded column is an outlier."""
    flags = [is_outlier(quoted(n), *b) for n, b in bounds.items()]
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def apply_actions(df: DataFrame, bounds: Bounds, actions: dict[str, str]) -> DataFrame:
    """One projection for clip and null, then one filter for removals.

    All bounds come from the table before any removal. Removals look at the unchanged
    value, which each removing column still has because it is neither clipped nor nulled.
    """
    changes, removing = {}, {}
    for name, action in actions.items():
        action = label(action)
        if action not in OUTLIER_ACTIONS:
            raise ValueError(f"unknown outlier action: {action!r}")
        low, high = bounds.get(name, (None, None))
        if action == "clip":
            changes[name] = clip(quoted(name), dtype_of(df, name), low, high)
        elif action == "null":
            changes[name] = F.when(~is_outlier(quoted(name), low, high), quoted(name))
        elif action == "remove":
            removing[name] = (low, high)
    if removing:
        df = df.where(~removal(removing))
    return df.withColumns(changes) if changes else df


def treat_outliers(
    df: DataFrame, columns: list[str], method: str = "IQR", factor: float = 1.5, action: str = "remove"
) -> DataFrame:
    """One action for a list of columns."""
    bounds = outlier_bounds(df, columns, method, factor)
    return apply_actions(df, bounds, {n: action for n in columns})
