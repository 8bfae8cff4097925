"""Filling of nulls."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number_or_none
from ..functions.vocabulary import BOOLEAN, CATEGORICAL, DATE, IMPUTE_METHODS, NUMERIC, TEXT, label
from ..schema import dtype_of, is_integral, is_numeric, quoted
from ..session import small_frame
from .frequency import modes
from .order import fill_ordered
from .profile import NumericStats, add_quantiles, numeric_stats

ORDERED = ("forward", "backward", "interpolate")
STATIC = ("mean", "median", "mode", "fixed")


@dataclass
class Fill:
    """How one column is filled; ``value`` is None for methods that depend on the row."""

    column: str
    method: str
    reason: str = ""
    value: object = None
    nulls: int = 0


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.count_if(quoted(n).isNull()).alias(f"n{i}") for i, n in enumerate(columns)]).first()
    return {n: row[f"n{i}"] for i, n in enumerate(columns)}


def plan_fills(
    df: DataFrame, kinds: dict[str, str], chosen: dict[str, str] | None = None, skew_limit: float = 0.5
) -> list[Fill]:
    """Method and value for every column with nulls: the chosen method, else the
    recommendation for its kind.

    The jobs, whatever the number of columns: null counts, numeric moments and medians,
    and one value-frequency table when a mode is needed.
    """
    chosen = {n: label(m) for n, m in (chosen or {}).items() if m}
    nulls = {n: k for n, k in null_counts(df, df.columns).items() if k}
    columns = [n for n in df.columns if n in nulls]
    for n in columns:
        if chosen.get(n) in ("mean", "median", "interpolate") and not is_numeric(dtype_of(df, n)):
            raise ValueError(f"method {chosen[n]!r} needs a numeric column, {n!r} is none")

    def kind(n):
        return kinds.get(n, TEXT)

    numeric = [n for n in columns if kind(n) == NUMERIC and is_numeric(dtype_of(df, n)) and chosen.get(n) in (None, "mean", "median")]
    stats = numeric_stats(df, numeric, [])
    add_quantiles(df, stats, {n: [0.5] for n in numeric if chosen.get(n) in (None, "median")})
    with_mode = [n for n in columns if chosen.get(n) == "mode" or (n not in chosen and kind(n) in (CATEGORICAL, BOOLEAN))]
    top = modes(df, with_mode)
    return [_decide(n, kind(n), chosen.get(n), stats.get(n), top.get(n), skew_limit, nulls[n]) for n in columns]


def _decide(name, kind, method, stats: NumericStats | None, top, skew_limit, nulls) -> Fill:
    reason = "chosen"
    if method is None:
        method, reason = recommendation(kind, stats, top, skew_limit)
    value = None
    if method == "mean" and stats:
        value = stats.mean
    elif method == "median" and stats:
        value = stats.median
    elif method == "mode" and top:
        value = top[0]
    return Fill(name, method, reason, value, nulls)


def methods_for(kind: str) -> tuple[str, ...]:
    """Methods offered for a kind."""
    return IMPUTE_METHODS[label(kind)]


def recommendation(kind: str, stats: NumericStats | None, top, skew_limit: float = 0.5) -> tuple[str, str]:
    """Suggested method of a kind, with the reason."""
    if kind == NUMERIC:
        skew = stats.skew if stats else 0.0
        if abs(skew) < skew_limit:
            return "mean", f"symmetric distribution (skewness = {skew:.2f})"
        return "median", f"skewed distribution (skewness = {skew:.2f})"
    if kind in (CATEGORICAL, BOOLEAN):
        if top is None:
            return "keep", "no values to take a mode from"
        return "mode", f"{kind} column, mode {top[0]} occurs {top[1]} times"
    if kind == DATE:
        return "forward", "dates repeat the previous row"
    return "keep", "free text stays null"


def recommend(df: DataFrame, kinds: dict[str, str], skew_limit: float = 0.5) -> DataFrame:
    """Rows ``(column, method, reason, value)`` for every column of ``kinds``."""
    numeric = [n for n, k in kinds.items() if k == NUMERIC and is_numeric(dtype_of(df, n))]
    stats = numeric_stats(df, numeric, [0.5])
    top = modes(df, [n for n, k in kinds.items() if k in (CATEGORICAL, BOOLEAN)])
    rows = []
    for n, k in kinds.items():
        fill = _decide(n, k, None, stats.get(n), top.get(n), skew_limit, 0)
        rows.append({"column": n, "method": fill.method, "reason": fill.reason, "value": _shown(fill.value)})
    schema = pa.schema([(c, pa.string()) for c in ("column", "method", "reason", "value")])
    return small_frame(df.sparkSession, rows, schema)


def _shown(value) -> str | None:
    return None if value is None else str(value)


def filled(c: Column, dtype: T.DataType, value) -> Column:
    """Nulls replaced by a constant; a fraction is rounded half to even for integers."""
    if value is None:
        return c
    if is_integral(dtype):
        return F.coalesce(c, F.lit(round(value)).cast(dtype))
    if isinstance(dtype, T.BooleanType) and isinstance(value, str):
        value = value == "true"
    return F.coalesce(c, F.lit(value).cast(dtype))


def apply_fills(
    df: DataFrame, fills: list[Fill], order_by: list | None = None, partition_by: list[str] | None = None,
    position: str | None = None,
) -> DataFrame:
    """One projection for the constants, one ordered pass for the rest."""
    changes = {
        f.column: filled(quoted(f.column), dtype_of(df, f.column), f.value)
        for f in fills
        if f.method in STATIC and f.value is not None
    }
    if changes:
        df = df.withColumns(changes)
    ordered = {f.column: f.method for f in fills if f.method in ORDERED}
    return fill_ordered(df, ordered, order_by, partition_by, position=position) if ordered else df


def impute(
    df: DataFrame, columns: list[str], method: str, fixed_value=None, skew_limit: float = 0.5,
    order_by: list | None = None, partition_by: list[str] | None = None, position: str | None = None,
) -> DataFrame:
    """One method for a list of columns; columns it cannot apply to are left alone."""
    return apply_fills(df, plan_one_method(df, columns, method, fixed_value, skew_limit), order_by, partition_by, position)


def plan_one_method(df: DataFrame, columns: list[str], method: str, fixed_value=None, skew_limit: float = 0.5) -> list[Fill]:
    """Fills of the one-method step: ``auto``, ``mean``, ``median``, ``mode``, ``fixed``,
    ``forward``, ``backward``, ``interpolate``."""
    method = label(method)
    nulls = {n: k for n, k in null_counts(df, columns).items() if k}
    columns = [n for n in columns if n in nulls]
    numeric = [n for n in columns if is_numeric(dtype_of(df, n))]
    stats: dict[str, NumericStats] = {}
    if method in ("auto", "mean", "median"):
        stats = numeric_stats(df, numeric, [] if method == "mean" else [0.5])
    with_mode = columns if method == "mode" else [n for n in columns if n not in numeric] if method == "auto" else []
    top = modes(df, with_mode)
    fills = []
    for n in columns:
        is_number = n in numeric
        used, reason, value = method, "chosen", None
        if method == "auto":
            used = recommendation(NUMERIC, stats[n], None, skew_limit)[0] if is_number else "mode"
            reason = f"skewness = {stats[n].skew:.2f}" if is_number else "not numeric"
        elif method in ("mean", "median", "interpolate") and not is_number:
            fills.append(Fill(n, "skip", f"{method} needs a numeric column", None, nulls[n]))
            continue
        if used == "mean":
            value = stats[n].mean
        elif used == "median":
            value = stats[n].median
        elif used == "mode":
            value = top[n][0] if n in top else None
        elif used == "fixed":
            value = number_or_none(fixed_value) if is_number else fixed_value
            if value is None:
                fills.append(Fill(n, "skip", "fixed value is not numeric", None, nulls[n]))
                continue
        fills.append(Fill(n, used, reason, value, nulls[n]))
    return fills


def imputed_mask(before: str, after: Column) -> Column:
    """True where a cell was null and now holds a value; ``before`` names the null flag."""
    return F.col(before) & after.isNotNull()
