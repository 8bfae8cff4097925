"""The tables behind the charts."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_text
from ..schema import dtype_of, numeric_columns, quoted
from ..session import aggregate_row, small_frame
from .outliers import is_outlier
from .profile import NumericStats, null_table, numeric_stats, outlier_counts

HISTOGRAM_BINS, CARD_BINS = 30, 14
SAMPLED_POINTS, GRID_POINTS = 500, 200
KERNEL_CELLS, KERNEL_TERMS, KERNEL_REACH = 8, 8, 9
NULL_VALUE = "(null)"


# --- nulls --------------------------------------------------------------------------------

def null_ranking(df: DataFrame) -> DataFrame:
    """Columns with nulls, highest share first."""
    return null_table(df).where("nulls > 0").orderBy(F.col("null_pct").desc(), "column")


def null_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows ``(column, before, after)`` for columns with a null on either side."""
    both = null_table(before).withColumn("moment", F.lit("before")).unionByName(
        null_table(after).withColumn("moment", F.lit("after"))
    )
    table = both.groupBy("column").pivot("moment", ["before", "after"]).agg(F.first("nulls"))
    return table.where("coalesce(before, 0) > 0 or coalesce(after, 0) > 0")


# --- histograms -----------------------------------------------------------------------------

def _settled(x: Column, index: Column, edge, bins: int, left_closed: bool) -> Column:
    """Bin index corrected against the edges themselves, as the division may round."""
    if left_closed:
        moved = F.when(x < edge(index), index - 1).when((x >= edge(index + 1)) & (index < bins - 1), index + 1)
    else:
        moved = F.when((x <= edge(index)) & (index > 0), index - 1).when(x > edge(index + 1), index + 1)
    settled = moved.otherwise(index)
    return F.least(F.greatest(settled, F.lit(0)), F.lit(bins - 1))


def _bin_counts(values: DataFrame, index: Column, edges: list[float]) -> DataFrame:
    """Counts of all bins, empty ones included, from one aggregate."""
    bins = len(edges) - 1
    counts = values.select(index.cast("int").alias("bin")).agg(
        *[F.count_if(F.col("bin") == b).alias(f"b{b}") for b in range(bins)]
    )
    rows = [
        F.struct(
            F.lit(b).alias("bin"), F.lit(edges[b]).alias("start"), F.lit(edges[b + 1]).alias("end"), F.col(f"b{b}").alias("rows")
        )
        for b in range(bins)
    ]
    return counts.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal bins, left-closed, the last one closed; only values within ``low`` and ``high`` if given."""
    x = quoted(column).cast("double")
    values = df.where(x.isNotNull())
    if low is not None:
        values = values.where(x.between(low, high))
    ends = values.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    a, b = ends["a"], ends["b"]
    if a is None:
        a, b = 0.0, 1.0
    elif a == b:
        a, b = a - 0.5, b + 0.5
    step = (b - a) / bins
    edges = [a + i * step for i in range(bins)] + [b]
    index = F.floor((x - F.lit(a)) / F.lit(step))
    return _bin_counts(values, _settled(x, index, lambda i: F.lit(a) + i * F.lit(step), bins, True), edges)


def card_histogram(df: DataFrame, column: str, bins: int = CARD_BINS, iqr_factor: float = 1.5) -> DataFrame:
    """Right-closed bins with a flag on non-empty bins whose middle is outside the IQR bounds."""
    s = numeric_stats(df, [column], [0.25, 0.75])[column]
    x = quoted(column).cast("double")
    values = df.where(x.isNotNull())
    if not s.n:
        return _bin_counts(values, F.lit(0), [0.0, 1.0]).limit(0).withColumn("outside", F.lit(False))
    a, b = s.low, s.high
    if a == b:
        # Fixed share: a constant column is widened by 0.1% of its size
        a -= 0.001 * abs(a) if a else 0.001
        b += 0.001 * abs(b) if b else 0.001
        edges = [a + i * (b - a) / bins for i in range(bins)] + [b]
    else:
        edges = [a + i * (b - a) / bins for i in range(bins)] + [b]
        # Fixed share: the first edge is lowered by 0.1% of the range
        edges[0] = a - (b - a) * 0.001
    step = (b - a) / bins
    index = F.ceil((x - F.lit(a)) / F.lit(step)) - 1
    index = F.greatest(index, F.lit(0))
    counts = _bin_counts(values, _settled(x, index, lambda i: F.lit(a) + i * F.lit(step), bins, False), edges)
    low, high = s.iqr_bounds(iqr_factor)
    middle = (F.col("start") + F.col("end")) / 2
    return counts.withColumn("outside", (F.col("rows") > 0) & ((middle < low) | (middle > high)))


# --- distribution ---------------------------------------------------------------------------

_BOX = pa.schema([(n, pa.float64()) for n in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def box_stats(df: DataFrame, column: str, iqr_factor: float = 1.5) -> DataFrame:
    """Quartiles, and the smallest and largest value inside the IQR bounds."""
    s = numeric_stats(df, [column])[column]
    if not s.n:
        return small_frame(df.sparkSession, [], _BOX)
    low, high = s.iqr_bounds(iqr_factor)
    x = quoted(column).cast("double")
    inside = F.when(x.between(low, high), x)
    return df.agg(
        F.lit(s.q1).alias("q1"), F.lit(s.median).alias("median"), F.lit(s.q3).alias("q3"),
        F.coalesce(F.min(inside), F.lit(s.q1)).alias("whisker_low"),
        F.coalesce(F.max(inside), F.lit(s.q3)).alias("whisker_high"),
    )


def outlier_sample(
    df: DataFrame, column: str, key: list[str], iqr_factor: float = 1.5, limit: int = SAMPLED_POINTS, seed: int = 0
) -> DataFrame:
    """At most ``limit`` outlier values, chosen by a seeded hash of the row key."""
    s = numeric_stats(df, [column], [0.25, 0.75])[column]
    bounds = s.iqr_bounds(iqr_factor) if s.n else (None, None)
    chosen = df.where(is_outlier(quoted(column), *bounds))
    draw = F.xxhash64(*[quoted(k) for k in key], F.lit(seed))
    picked = chosen.select(*[quoted(k) for k in key], quoted(column).alias("value"), draw.alias("__draw"))
    return picked.orderBy("__draw", *[quoted(k) for k in key]).limit(limit).drop("__draw")


def distribution_histogram(df: DataFrame, column: str, iqr_factor: float = 1.5, include_outliers: bool = False) -> DataFrame:
    """Histogram of the values inside the IQR bounds, or of all values."""
    if include_outliers:
        return histogram(df, column)
    s = numeric_stats(df, [column], [0.25, 0.75])[column]
    low, high = s.iqr_bounds(iqr_factor) if s.n else (None, None)
    return histogram(df, column, HISTOGRAM_BINS, low, high)


_MEASURES = pa.schema([("measure", pa.string()), ("value", pa.float64())])


def distribution_summary(df: DataFrame, column: str, iqr_factor: float = 1.5) -> DataFrame:
    """Rows ``(measure, value)`` of one numeric column."""
    s = numeric_stats(df, [column])[column]
    outliers = outlier_counts(df, {column: s.iqr_bounds(iqr_factor)})[column] if s.n else 0
    rows = [
        ("rows", s.n), ("mean", s.mean), ("median", s.median), ("std", s.std), ("min", s.low),
        ("max", s.high), ("skewness", s.skew), ("outliers", outliers),
    ]
    return small_frame(
        df.sparkSession, [{"measure": m, "value": None if v is None else float(v)} for m, v in rows], _MEASURES
    )


def stats_comparison(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Rows ``(measure, before, after)``."""
    b, a = numeric_stats(before, [column], [0.5])[column], numeric_stats(after, [column], [0.5])[column]

    def measures(s: NumericStats) -> list:
        return [("rows", float(s.n)), ("mean", s.mean), ("median", s.median), ("std", s.std), ("skewness", s.skew)]

    rows = [{"measure": m, "before": v, "after": w} for (m, v), (_, w) in zip(measures(b), measures(a))]
    schema = pa.schema([("measure", pa.string()), ("before", pa.float64()), ("after", pa.float64())])
    return small_frame(before.sparkSession, rows, schema)


def density_comparison(before: DataFrame, after: DataFrame, column: str, points: int = GRID_POINTS) -> DataFrame:
    """Rows ``(moment, value, density)``: Gaussian density of both sides on a shared grid."""
    x = quoted(column).cast("double").alias("x")
    sides = {"before": before.select(x), "after": after.select(x)}
    # Both sides as columns of one table, whose passes serve both
    none = F.lit(None).cast("double")
    both = sides["before"].select(F.col("x").alias("before"), none.alias("after")).unionByName(
        sides["after"].select(none.alias("before"), F.col("x").alias("after")))
    stats = numeric_stats(both, list(sides), [0.25, 0.75])
    known = [s for s in stats.values() if s.n]
    if not known:
        schema = pa.schema([("moment", pa.string()), ("value", pa.float64()), ("density", pa.float64())])
        return small_frame(before.sparkSession, [], schema)
    lo, hi = min(s.low for s in known), max(s.high for s in known)
    steps = points - 1 if hi > lo else 0
    return _densities(sides, stats, lo, hi, steps)


def bandwidth(s: NumericStats) -> float:
    """Width of the kernel by Silverman's rule; 0 for a column without spread."""
    if not s.std:
        return 0.0
    quartiles = (s.q3 - s.q1) / 1.34
    return 0.9 / s.n ** 0.2 * (min(quartiles, s.std) if quartiles > 0 else s.std)


def _densities(sides: dict[str, DataFrame], stats: dict[str, NumericStats], lo: float, hi: float, steps: int) -> DataFrame:
    """Density at ``steps + 1`` equally spaced points from all values of ``x`` of each side.

    Values are gathered in cells of an eighth of a kernel width, of which only the power sums
    around the middle go through the shuffle. A cell's share of a point is the Gaussian at its
    middle times a series in those sums and the Hermite polynomials; eight terms leave an
    error below 1e-11 of the kernel's height. Points over nine widths away get nothing.
    """
    widths = {m: bandwidth(s) if steps else 0.0 for m, s in stats.items()}
    step = (hi - lo) / steps if steps else 0.0
    spark = next(iter(sides.values())).sparkSession
    grid = spark.range(steps + 1).select(F.explode(F.array(*[F.lit(m) for m in sides])).alias("moment"), F.col("id").alias("point"))
    value = (F.lit(lo) + F.col("point") * F.lit(step)).alias("value")
    # Positions of points and cells, both in kernel widths from the low end
    scaled = [
        d.where("x is not null").select(F.lit(m).alias("moment"), F.lit(step / w).alias("apart"), ((F.col("x") - F.lit(lo)) / F.lit(w)).alias("z"))
        for (m, d), w in zip(sides.items(), widths.values()) if w
    ]
    if not scaled:
        return grid.select("moment", value, F.lit(0.0).alias("density"))
    placed = reduce(DataFrame.unionByName, scaled).select(
        "moment", "apart", (F.rint(F.col("z") * KERNEL_CELLS) / KERNEL_CELLS).alias("cell"), "z")
    off, power, sums = F.col("z") - F.col("cell"), F.lit(1.0), []
    for k in range(KERNEL_TERMS):
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * off
    cells = placed.groupBy("moment", "apart", "cell").agg(*sums)

    first = F.greatest(F.ceil((F.col("cell") - KERNEL_REACH) / F.col("apart")), F.lit(0))
    last = F.least(F.floor((F.col("cell") + KERNEL_REACH) / F.col("apart")), F.lit(steps))
    near = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    t = F.col("point") * F.col("apart") - F.col("cell")
    parts = near.select(
        "moment", "point", F.exp(-t * t / 2).alias("height"), t.alias("t"), F.array(*[f"m{k}" for k in range(KERNEL_TERMS)]).alias("m"))
    # h(k+1) = (t h(k) - h(k-1)) / (k+1): Hermite polynomials over k!
    series = F.aggregate(
        "m",
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("h"), F.lit(0.0).alias("before"), F.lit(0.0).alias("k")),
        lambda a, m: F.struct(
            (a["sum"] + m * a["h"]).alias("sum"), ((F.col("t") * a["h"] - a["before"]) / (a["k"] + 1)).alias("h"),
            a["h"].alias("before"), (a["k"] + 1).alias("k"),
        ),
        lambda a: a["sum"],
    )
    kernel = parts.select("moment", "point", (F.col("height") * series).alias("part"))
    everywhere = grid.withColumn("part", F.lit(0.0)).unionByName(kernel)
    summed = everywhere.groupBy("moment", "point").agg(F.sum("part").alias("total"))
    scale = F.lit(0.0)
    for m, w in widths.items():
        if w:
            scale = F.when(F.col("moment") == m, 1 / (stats[m].n * w * math.sqrt(2 * math.pi))).otherwise(scale)
    return summed.select("moment", value, F.greatest(F.col("total") * scale, F.lit(0.0)).alias("density"))


# --- categories and correlation -----------------------------------------------------------------

def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values and the rest as one row, nulls as a value of their own."""
    shown = df.select(F.coalesce(as_text(quoted(column), dtype_of(df, column)), F.lit(NULL_VALUE)).alias("value"))
    counts = shown.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    best = counts.orderBy(F.col("rows").desc(), "value").limit(n)
    totals = counts.agg(F.sum("rows").alias("all"), F.count(F.lit(1)).alias("values"))
    # At most n rows reach this aggregate
    kept = best.agg(F.sort_array(F.collect_list(F.struct("rows", "value")), asc=False).alias("kept"), F.sum("rows").alias("top"))
    packed = kept.withColumn("t", totals.select(F.struct("*")).scalar())
    others = F.when(
        F.col("t.values") > n,
        F.array(F.struct(
            F.concat(F.lit("others ("), (F.col("t.values") - n).cast("string"), F.lit(")")).alias("value"),
            (F.col("t.all") - F.col("top")).alias("rows"), F.lit(True).alias("others"),
        )),
    )
    top = F.transform("kept", lambda k: F.struct(k["value"].alias("value"), k["rows"].alias("rows"), F.lit(False).alias("others")))
    rows = packed.select(
        F.explode(F.concat(top, F.coalesce(others, F.array().cast("array<struct<value:string,rows:bigint,others:boolean>>")))).alias("r"),
        F.col("t.all").alias("all"),
    )
    return rows.select("r.value", "r.rows", F.bround(F.col("r.rows") * 100.0 / F.col("all"), 1).alias("pct"), "r.others")


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[int, int], float | None]:
    """Pearson correlation of every pair over the rows where both are present; None
    where a side is constant there.

    Two aggregates: means first, then plain sums of the deviations from them. A pair of
    columns without nulls adds a single sum to the second one.
    """
    if not columns:
        return {}
    size = len(columns)
    x = [quoted(n).cast("double") for n in columns]
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(x):
        measures += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    first = aggregate_row(df, measures)
    full = [first[f"n{i}"] == first["rows"] for i in range(size)]
    d = [c - F.lit(first[f"m{i}"]) for i, c in enumerate(x)]

    sums = []
    for i in range(size):
        sums += [F.sum(d[i]).alias(f"s{i}"), F.sum(d[i] * d[i]).alias(f"q{i}")]
        for j in range(i + 1, size):
            sums.append(F.sum(d[i] * d[j]).alias(f"p{i}_{j}"))
            if full[i] and full[j]:
                continue
            # A null in the other column makes the term null and leaves it out
            here, there = d[i] + d[j] * 0, d[j] + d[i] * 0
            sums += [
                F.count(here).alias(f"c{i}_{j}"),
                F.sum(here).alias(f"a{i}_{j}"), F.sum(here * here).alias(f"aa{i}_{j}"),
                F.sum(there).alias(f"b{i}_{j}"), F.sum(there * there).alias(f"bb{i}_{j}"),
                F.min(here).alias(f"alo{i}_{j}"), F.max(here).alias(f"ahi{i}_{j}"),
                F.min(there).alias(f"blo{i}_{j}"), F.max(there).alias(f"bhi{i}_{j}"),
            ]
    second = aggregate_row(df, sums)
    constant = [first[f"lo{i}"] == first[f"hi{i}"] for i in range(size)]
    result: dict[tuple[int, int], float | None] = {}
    for i in range(size):
        result[i, i] = None if constant[i] or first[f"n{i}"] < 2 else 1.0
        for j in range(i + 1, size):
            if full[i] and full[j]:
                n, flat = first["rows"], constant[i] or constant[j]
                a, aa, b, bb = (second[k] for k in (f"s{i}", f"q{i}", f"s{j}", f"q{j}"))
            else:
                n = second[f"c{i}_{j}"]
                a, aa, b, bb = (second[f"{k}{i}_{j}"] for k in ("a", "aa", "b", "bb"))
                flat = any(second[f"{k}lo{i}_{j}"] == second[f"{k}hi{i}_{j}"] for k in ("a", "b"))
            if n < 2 or flat:
                result[i, j] = None
                continue
            spread = math.sqrt((aa - a * a / n) * (bb - b * b / n))
            result[i, j] = max(-1.0, min(1.0, (second[f"p{i}_{j}"] - a * b / n) / spread)) if spread else None
    return result


def _rounded(value: float | None, digits: int) -> float | None:
    return None if value is None else round(value, digits) + 0.0  # no negative zero


def correlation_matrix(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Wide matrix of the numeric columns, three decimals; null for constant columns.

    ``max_columns`` keeps the first ones only.
    """
    names = numeric_columns(df)[:max_columns]
    r = correlations(df, names)
    rows = [
        {"column": a, **{b: _rounded(r[min(i, j), max(i, j)], 3) for j, b in enumerate(names)}} for i, a in enumerate(names)
    ]
    return small_frame(df.sparkSession, rows, pa.schema([("column", pa.string())] + [(n, pa.float64()) for n in names]))


def correlation_pairs(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Rows ``(x, y, r, strength)`` for every ordered pair with a correlation, two decimals."""
    names = numeric_columns(df)[:max_columns]
    r = correlations(df, names)
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            value = _rounded(r[min(i, j), max(i, j)], 2)
            if value is not None:
                rows.append({"x": a, "y": b, "r": value, "strength": abs(value)})
    schema = pa.schema([("x", pa.string()), ("y", pa.string()), ("r", pa.float64()), ("strength", pa.float64())])
    return small_frame(df.sparkSession, rows, schema)
