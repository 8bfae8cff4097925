"""Which cells differ from the source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_text
from ..functions.vocabulary import NUMERIC, TEXT, label
from ..schema import dtype_of, quoted
from .kinds import convert, detect_decimal_comma

# Fixed tolerance of number comparison, relative above one.
TOLERANCE = 1e-9


def _same(before: Column, after: Column, kind: str, types: tuple[T.DataType, T.DataType]) -> Column:
    if kind == NUMERIC:
        a, b = before.cast("double"), after.try_cast("double")
        close = F.abs(a - b) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(a))
        return (a.isNull() & b.isNull()) | F.coalesce(close, F.lit(False))
    return as_text(before, types[0]).eqNullSafe(as_text(after, types[1]))


def changed_cells(
    raw: DataFrame, out: DataFrame, row_id: str, kinds: dict[str, str],
    rename: dict | None = None, decimal_comma: dict[str, bool] | None = None,
) -> DataFrame:
    """``out`` with a flag ``<name>_changed`` per column that exists in the source.

    The source goes through the same type conversion, so a new format alone
    (``1.500,00`` to 1500) is no change. Both sides meet in one join on the unique row id.
    """
    origin = {new: old for old, new in (rename or {}).items()}
    pairs = {n: origin.get(n, n) for n in out.columns if n != row_id and origin.get(n, n) in raw.columns}
    kind_of = {n: label(kinds.get(n, TEXT)) for n in pairs}
    if decimal_comma is None:
        spelled = [o for n, o in pairs.items() if kind_of[n] == NUMERIC and isinstance(dtype_of(raw, o), T.StringType)]
        decimal_comma = detect_decimal_comma(raw, spelled)
    source = raw.select(
        quoted(row_id).alias("__id"),
        *[
            convert(quoted(o), dtype_of(raw, o), kind_of[n], decimal_comma.get(o, False)).alias(f"__source{i}")
            for i, (n, o) in enumerate(pairs.items())
        ],
    )
    joined = out.join(source, quoted(row_id) == F.col("__id"))
    return joined.select(
        *[quoted(n) for n in out.columns],
        *[(~_same(F.col(f"__source{i}"), quoted(n), kind_of[n], (dtype_of(joined, f"__source{i}"), dtype_of(out, n)))).alias(f"{n}_changed") for i, n in enumerate(pairs)],
    )


def _flags(df: DataFrame, suffixes: tuple[str, ...]) -> list[str]:
    return [n for n in df.columns if n.endswith(suffixes)]


def changed_rows(
    flagged: DataFrame, row_id: str, only_changed: bool = False, limit: int = 1000,
    suffixes: tuple[str, ...] = ("_changed", "_imputed"),
) -> DataFrame:
    """Preview of the result: changed rows first, source order inside, with the source
    row number (from 1)."""
    any_change = reduce(lambda a, b: a | b, [quoted(n) for n in _flags(flagged, suffixes)], F.lit(False))
    view = flagged.withColumns({"row_changed": any_change, "source_row": quoted(row_id) + 1})
    if only_changed:
        view = view.where("row_changed")
    return view.orderBy(F.col("row_changed").desc(), quoted(row_id)).limit(limit)


def change_counts(flagged: DataFrame, suffix: str = "_changed") -> DataFrame:
    """Rows ``(column, cells)``: flagged cells per column, from one aggregate."""
    names = _flags(flagged, (suffix,))
    counts = flagged.agg(*[F.count_if(quoted(n)).alias(f"c{i}") for i, n in enumerate(names)])
    rows = [
        F.struct(F.lit(n.removesuffix(suffix)).alias("column"), F.col(f"c{i}").alias("cells")) for i, n in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))
