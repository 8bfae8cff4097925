"""Column profiles."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocabulary import DATE, KINDS, NUMERIC
from ..schema import is_numeric, numeric_columns, quoted
from ..session import aggregate_row, small_frame
from . import frequency as freq
from .quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]

# Fixed limits of the labels: 0.15 symmetric, 0.5 slight, 1 moderate.
SYMMETRIC, SLIGHT, MODERATE = 0.15, 0.5, 1.0

# Fixed limits of the completeness bands, in percent.
FULL, GOOD = 99.95, 70.0

NO_NULLS, ALL_NULL = "", "whole column empty"
AT_START, AT_END = "nulls at the start", "nulls at the end"
ONE_BLOCK, SCATTERED = "nulls in one block", "nulls scattered"


# --- scalar formulas ------------------------------------------------------------------

def skewness(mean: Column, median: Column, std: Column, n: Column) -> Column:
    """Pearson's second coefficient, 0 below two values or without spread."""
    return F.when((n >= 2) & (std != 0), 3 * (mean - median) / std).otherwise(F.lit(0.0))


def skewness_value(mean, median, std, n) -> float:
    return 3 * (mean - median) / std if n >= 2 and std else 0.0


def sample_kurtosis(kurtosis: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one, 0 up to three values."""
    k = n.cast("double")
    corrected = F.try_divide(k - 1, (k - 2) * (k - 3)) * ((k + 1) * kurtosis + 6)
    return F.when((n > 3) & kurtosis.isNotNull(), corrected).otherwise(F.lit(0.0))


def skewness_label(value: Column) -> Column:
    """Five-way label: symmetric, or moderate/strong with the side of the tail."""
    side = F.when(value > 0, "right").otherwise("left")
    strength = F.when(F.abs(value) < MODERATE, "moderate ").otherwise("strong ")
    return F.when(F.abs(value) < SYMMETRIC, "symmetric").otherwise(F.concat(strength, side))


def skewness_grade(value: Column) -> Column:
    """Four-way label."""
    a = F.abs(value)
    return F.when(a < SYMMETRIC, "symmetric").when(a < SLIGHT, "slight").when(a < MODERATE, "moderate").otherwise("strong")


# --- counts ---------------------------------------------------------------------------

def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def null_table(df: DataFrame) -> DataFrame:
    """Rows ``(column, nulls, null_pct)`` in table order, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(quoted(n)).alias(f"n{i}") for i, n in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            F.bround(_percent(F.col("rows") - F.col(f"n{i}"), F.col("rows")), 2).alias("null_pct"),
        )
        for i, n in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows ``(column, distinct)``: non-null distinct values per column."""
    names = [n for n in df.columns if freq.countable(df, n)]
    if approximate:
        counts = df.agg(*[F.approx_count_distinct(quoted(n)).alias(f"d{i}") for i, n in enumerate(names)])
        rows = [F.struct(F.lit(n).alias("column"), F.col(f"d{i}").alias("distinct")) for i, n in enumerate(names)]
        return counts.select(F.inline(F.array(*rows)))
    counted = freq.summary(freq.value_frequency(df, names)).select("column", "distinct")
    # A column without any value has no frequency row
    zeros = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(0).cast("long").alias("distinct")) for n in names]))
    )
    return counted.unionByName(zeros).groupBy("column").agg(F.max("distinct").alias("distinct"))


def quality(df: DataFrame) -> DataFrame:
    """One row ``(quality)``: share of non-null cells in percent, 100 for an empty table."""
    if not df.columns:
        return df.sparkSession.range(1).select(F.lit(100.0).alias("quality"))
    present = sum((F.count(quoted(n)) for n in df.columns[1:]), F.count(quoted(df.columns[0])))
    share = F.try_divide(present * 100.0, F.count(F.lit(1)) * len(df.columns))
    return df.agg(F.coalesce(share, F.lit(100.0)).alias("quality"))


def completeness(df: DataFrame) -> DataFrame:
    """Rows ``(column, complete_pct, band)`` with bands full, good and low."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(quoted(n)).alias(f"n{i}") for i, n in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            (100.0 - _percent(F.col("rows") - F.col(f"n{i}"), F.greatest("rows", F.lit(1)))).alias("complete_pct"),
        )
        for i, n in enumerate(df.columns)
    ]
    pct = F.col("complete_pct")
    band = F.when(pct >= FULL, "full").when(pct >= GOOD, "good").otherwise("low")
    return counts.select(F.inline(F.array(*rows))).withColumn("band", band)


# --- null pattern -----------------------------------------------------------------------

def null_patterns(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """Rows ``(column, nulls, pattern)``.

    The pattern follows from comparing the smallest and largest order key of the null
    and of the other rows, so nothing is sorted or numbered: two scans, no row shuffle.
    The order must be unique.
    """
    key = quoted(order_by[0]) if len(order_by) == 1 else F.struct(*[quoted(o) for o in order_by])
    keyed = df.select(key.alias("key"), *[quoted(n).isNull().alias(f"m{i}") for i, n in enumerate(columns)])
    ends = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        missing = F.col(f"m{i}")
        ends += [
            F.count_if(missing).alias(f"nulls{i}"),
            F.min(F.when(missing, F.col("key"))).alias(f"first_null{i}"),
            F.max(F.when(missing, F.col("key"))).alias(f"last_null{i}"),
            F.min(F.when(~missing, F.col("key"))).alias(f"first_value{i}"),
            F.max(F.when(~missing, F.col("key"))).alias(f"last_value{i}"),
        ]
    bounds = keyed.agg(*ends)
    packed = bounds.select(F.struct("*").alias("b")).scalar()
    b = F.col("b")
    between = keyed.withColumn("b", packed).agg(
        F.first("b").alias("b"),
        *[
            F.count_if(~F.col(f"m{i}") & F.col("key").between(b[f"first_null{i}"], b[f"last_null{i}"])).alias(f"gap{i}")
            for i in range(len(columns))
        ],
    )
    rows = []
    for i, n in enumerate(columns):
        nulls = F.coalesce(b[f"nulls{i}"], F.lit(0).cast("long"))
        pattern = (
            F.when(nulls == 0, NO_NULLS)
            .when(nulls == b["rows"], ALL_NULL)
            .when(b[f"last_null{i}"] < b[f"first_value{i}"], AT_START)
            .when(b[f"first_null{i}"] > b[f"last_value{i}"], AT_END)
            .when((nulls >= 3) & (F.col(f"gap{i}") == 0), ONE_BLOCK)
            .otherwise(SCATTERED)
        )
        rows.append(F.struct(F.lit(n).alias("column"), nulls.alias("nulls"), pattern.alias("pattern")))
    return between.select(F.inline(F.array(*rows)))


# --- numeric statistics -------------------------------------------------------------------

@dataclass
class NumericStats:
    """Statistics of one numeric column, held on the driver."""

    name: str
    rows: int
    n: int
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    kurtosis: float = 0.0
    q1: float | None = None
    median: float | None = None
    q3: float | None = None

    @property
    def nulls(self) -> int:
        return self.rows - self.n

    @property
    def skew(self) -> float:
        return skewness_value(self.mean, self.median, self.std, self.n) if self.n else 0.0

    def iqr_bounds(self, factor: float = 1.5) -> tuple[float, float]:
        spread = self.q3 - self.q1
        return self.q1 - factor * spread, self.q3 + factor * spread

    def z_bounds(self, factor: float = 1.5) -> tuple[float | None, float | None]:
        if self.std is None:
            return None, None
        return self.mean - factor * self.std, self.mean + factor * self.std


def numeric_stats(
    df: DataFrame, columns: list[str], quantiles: list[float] | dict[str, list[float]] | None = None,
) -> dict[str, NumericStats]:
    """Statistics of all columns: one aggregate for the moments, then the quantiles."""
    if not columns:
        return {}
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        x = quoted(name).cast("double")
        n = F.count(x)
        measures += [
            n.alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"), sample_kurtosis(F.kurtosis(x), n).alias(f"kurt{i}"),
        ]
    row = aggregate_row(df, measures)
    stats = {
        name: NumericStats(
            name, row["rows"], row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"low{i}"], row[f"high{i}"], row[f"kurt{i}"]
        )
        for i, name in enumerate(columns)
    }
    add_quantiles(df, stats, QUARTILES if quantiles is None else quantiles)
    return stats


def add_quantiles(df: DataFrame, stats: dict[str, NumericStats], quantiles) -> None:
    wanted = quantiles if isinstance(quantiles, dict) else {n: quantiles for n in stats}
    found = exact_quantiles(df, wanted, {n: s.n for n, s in stats.items()})
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    for n, values in found.items():
        for p, v in zip(wanted[n], values):
            setattr(stats[n], names[p], v)


def outlier_counts(df: DataFrame, bounds: dict[str, tuple]) -> dict[str, int]:
    """Values strictly outside the bounds, all columns in one aggregate."""
    known = {n: b for n, b in bounds.items() if b[0] is not None}
    if not known:
        return {n: 0 for n in bounds}
    row = df.agg(
        *[
            F.count_if((quoted(n) < F.lit(lo)) | (quoted(n) > F.lit(hi))).alias(f"o{i}")
            for i, (n, (lo, hi)) in enumerate(known.items())
        ]
    ).first()
    return {**{n: 0 for n in bounds}, **{n: row[f"o{i}"] for i, n in enumerate(known)}}


def skewness_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows ``(column, skewness, label, grade)`` for numeric columns."""
    columns = numeric_columns(df) if columns is None else columns
    stats = numeric_stats(df, columns, [0.5])
    rows = [{"column": n, "skewness": s.skew} for n, s in stats.items()]
    frame = small_frame(df.sparkSession, rows, pa.schema([("column", pa.string()), ("skewness", pa.float64())]))
    return frame.withColumns({"label": skewness_label(F.col("skewness")), "grade": skewness_grade(F.col("skewness"))})


_NUMERIC_PROFILE = pa.schema(
    [("column", pa.string()), ("nulls", pa.int64()), ("present", pa.int64())]
    + [(n, pa.float64()) for n in ("min", "max", "mean", "median", "std", "kurtosis", "skewness")]
    + [("outliers", pa.int64())]
)


def numeric_profile(df: DataFrame, columns: list[str] | None = None, iqr_factor: float = 1.5) -> DataFrame:
    """One row of statistics per numeric column that has values."""
    columns = numeric_columns(df) if columns is None else columns
    stats = {n: s for n, s in numeric_stats(df, columns).items() if s.n}
    outliers = outlier_counts(df, {n: s.iqr_bounds(iqr_factor) for n, s in stats.items()})
    rows = [{"column": n, "nulls": s.nulls, "present": s.n, **_numeric_fields(s), "outliers": outliers[n]} for n, s in stats.items()]
    return small_frame(df.sparkSession, rows, _NUMERIC_PROFILE)


def _numeric_fields(s: NumericStats) -> dict:
    return {
        "min": s.low, "max": s.high, "mean": s.mean, "median": s.median,
        "std": s.std if s.n > 1 else 0.0, "kurtosis": s.kurtosis, "skewness": s.skew,
    }


def date_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, min, max)`` for date columns."""
    ends = df.agg(
        *[F.min(quoted(n).cast("timestamp_ntz")).alias(f"a{i}") for i, n in enumerate(columns)],
        *[F.max(quoted(n).cast("timestamp_ntz")).alias(f"b{i}") for i, n in enumerate(columns)],
    )
    rows = [
        F.struct(F.lit(n).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"))
        for i, n in enumerate(columns)
    ]
    return ends.select(F.inline(F.array(*rows)))


def category_profile(df: DataFrame, columns: list[str], top: int = 4) -> DataFrame:
    """Most frequent values per column: rows ``(column, rank, value, rows, pct)``."""
    frequency = freq.value_frequency(df, columns, as_text=True)
    totals = freq.summary(frequency).select("column", "present")
    # One row per column on each side of the join at most `top` times: bounded by the schema
    best = freq.ranked(frequency, top).join(F.broadcast(totals), "column")
    pct = F.bround(F.col("rows") * 100.0 / F.col("present"), 0).cast("int")
    return best.select("column", "rank", F.col("text").alias("value"), "rows", pct.alias("pct"))


def entropy_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, distinct, entropy)``: Shannon entropy in bits over non-null values."""
    return freq.summary(freq.value_frequency(df, columns, as_text=True)).select("column", "distinct", "entropy")


def diagnosis(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, null share, distinct values, skewness and its label."""
    stats = numeric_stats(df, numeric_columns(df), [0.5])
    rows = [
        {"column": f.name, "type": f.dataType.simpleString(), "skewness": stats[f.name].skew if f.name in stats else None}
        for f in df.schema.fields
    ]
    schema = pa.schema([("column", pa.string()), ("type", pa.string()), ("skewness", pa.float64())])
    base = small_frame(df.sparkSession, rows, schema)
    skew = F.col("skewness")
    # All three sides hold one row per column
    joined = base.join(null_table(df), "column").join(distinct_counts(df), "column", "left")
    return joined.select(
        "column", "type", "nulls", "null_pct", "distinct",
        F.bround(skew, 3).alias("skewness"),
        F.when(skew.isNull(), "").otherwise(skewness_label(skew)).alias("label"),
    )


# --- full profile ---------------------------------------------------------------------------

PROFILE_SCHEMA = pa.schema(
    [("column", pa.string()), ("kind", pa.string()), ("nulls", pa.int64()), ("total", pa.int64()),
     ("distinct", pa.int64()), ("pattern", pa.string())]
    + [(n, pa.float64()) for n in ("min", "max", "mean", "median", "std", "kurtosis", "skewness")]
    + [("outliers", pa.int64()), ("first_date", pa.timestamp("us")), ("last_date", pa.timestamp("us")),
       ("entropy", pa.float64()), ("top", pa.string())]
)


def full_profile(
    df: DataFrame, kinds: dict[str, str], iqr_factor: float = 1.5, order_by: list[str] | None = None, top: int = 4,
    approximate_distinct: bool = False,
) -> DataFrame:
    """One row per column with the measures of its kind.

    ``pattern`` needs ``order_by``. ``approximate_distinct`` estimates the distinct values
    of numeric and date columns, which keeps them out of the frequency shuffle. Jobs: null counts and patterns, numeric moments and
    quantiles, outlier counts, date ends, and one frequency table for everything that
    counts values.
    """
    names = [n for n in df.columns if n in kinds]
    numeric = [n for n in names if kinds[n] == NUMERIC and is_numeric(df.schema[n].dataType)]
    dates = [n for n in names if kinds[n] == DATE]
    spoken = [n for n in names if n not in numeric and n not in dates and freq.countable(df, n)]
    rows = {n: {"column": n, "kind": kinds[n], "pattern": None} for n in names}

    total = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    for i, n in enumerate(names):
        rows[n].update(total=total["rows"], nulls=total["rows"] - total[f"n{i}"], distinct=0)
    if order_by:
        for r in null_patterns(df, names, order_by).collect():
            rows[r["column"]]["pattern"] = r["pattern"]
    stats = {n: s for n, s in numeric_stats(df, numeric).items() if s.n}
    for n, count in outlier_counts(df, {n: s.iqr_bounds(iqr_factor) for n, s in stats.items()}).items():
        rows[n].update(_numeric_fields(stats[n]), outliers=count)
    if dates:
        for r in date_profile(df, dates).collect():
            rows[r["column"]].update(first_date=r["min"], last_date=r["max"])
    counted = [n for n in names if freq.countable(df, n)]
    if approximate_distinct:
        estimated = [n for n in counted if n not in spoken]
        if estimated:
            for r in distinct_counts(df.select(*[quoted(n) for n in estimated]), approximate=True).collect():
                rows[r["column"]]["distinct"] = r["distinct"]
        counted = spoken
    if counted:
        frequency = freq.value_frequency(df, counted)
        for r in freq.summary(frequency).collect():
            rows[r["column"]]["distinct"] = r["distinct"]
            if r["column"] in spoken:
                rows[r["column"]]["entropy"] = r["entropy"]
    if spoken:
        for r in category_profile(df, spoken, top).orderBy("column", "rank").collect():
            earlier = rows[r["column"]].get("top")
            entry = f"{r['value']} {r['pct']}%"
            rows[r["column"]]["top"] = f"{earlier}; {entry}" if earlier else entry
    return small_frame(df.sparkSession, list(rows.values()), PROFILE_SCHEMA)


def list_columns(profile: DataFrame, show: str = "all", search: str = "", order: str = "nulls") -> DataFrame:
    """Columns of a profile: filtered by problems, kind or name, and sorted.

    ``show`` is ``all``, ``problems`` or a kind; ``order`` is ``nulls``, ``name`` or ``kind``.
    """
    outliers = F.coalesce(F.col("outliers"), F.lit(0))
    if show == "problems":
        profile = profile.where((F.col("nulls") > 0) | (outliers > 0))
    elif show in KINDS:
        profile = profile.where(F.col("kind") == show)
    elif show != "all":
        raise ValueError(f"unknown column filter: {show!r}")
    if search:
        profile = profile.where(F.contains(F.lower("column"), F.lower(F.lit(search))))
    name = F.lower("column")
    orders = {
        "nulls": [F.col("nulls").desc(), outliers.desc(), name],
        "name": [name],
        "kind": [F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), name],
    }
    return profile.orderBy(*orders[order])
