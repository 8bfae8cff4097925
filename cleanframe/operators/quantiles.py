"""Exact quantiles of many columns at any size.

A wanted rank is searched by refinement. One scan counts the values of all columns by bucket: first
by sixteenths of an octave of their size, then by equal parts of the bucket that holds the
rank, and, once few values are left in it, by value. A bucket carries its count and its smallest
and largest value, so the counts alone decide and the result is exact. Each pass is one grouping
that is combined before its shuffle; no state holds values, and a histogram has a bounded number of
rows whatever the size of the table. Any column needs at most seven passes, most need two or three.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import quoted

OCTAVE_PARTS = 16
PARTS = 4096
FEW_VALUES = 4096  # a bucket with no more values is counted by value
AT_ONCE = 64  # brackets of one scan


@dataclass
class _Bracket:
    """Values of a column from ``low`` to ``high``, among which the wanted ranks (from 0) lie."""

    name: str
    ranks: list[int]
    before: int = 0  # values below the bracket
    inside: int | None = None
    low: float | None = None
    high: float | None = None


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    position = p * (n - 1)
    low = min(int(math.floor(position)), n - 1)
    return low, min(low + 1, n - 1), position - low


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], counts: dict[str, int], few: int = FEW_VALUES
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; ``counts`` holds the non-null counts."""
    wanted = {n: list(ps) for n, ps in wanted.items() if ps}
    result: dict[str, list[float | None]] = {n: [None] * len(ps) for n, ps in wanted.items()}
    live = {n: ps for n, ps in wanted.items() if counts.get(n, 0) > 0}
    found = order_statistics(df, {n: sorted({r for p in ps for r in _ranks(p, counts[n])[:2]}) for n, ps in live.items()}, few)
    for n, ps in live.items():
        for j, p in enumerate(ps):
            low, high, part = _ranks(p, counts[n])
            a, b = found[n, low], found[n, high]
            result[n][j] = a if part == 0 or a == b else a + (b - a) * part
    return result


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], few: int = FEW_VALUES) -> dict[tuple[str, int], float]:
    """Values at the given ranks (from 0) of each column, at any number of values."""
    found: dict[tuple[str, int], float] = {}
    waiting = [_Bracket(n, rs) for n, rs in ranks.items() if rs]
    while waiting:
        narrower = []
        for start in range(0, len(waiting), AT_ONCE):
            narrower += _refined(df, waiting[start:start + AT_ONCE], few, found)
        waiting = narrower
    return found


def _by_size(x: Column) -> Column:
    """Bucket by sign and sixteenth of an octave, in the order of the values."""
    octaves = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * OCTAVE_PARTS) + 20_000
    return F.when(x == 0, 0).otherwise(F.signum(x) * octaves).cast("double")


def _bucket(b: _Bracket, x: Column, few: int) -> Column:
    if b.inside is None:
        return _by_size(x)
    if b.inside <= few:
        return x
    # Rounding keeps the order; the ends fall into the first and the last bucket.
    return F.floor((x - b.low) / (b.high - b.low) * PARTS).cast("double")


def _refined(df: DataFrame, brackets: list[_Bracket], few: int, found: dict[tuple[str, int], float]) -> list[_Bracket]:
    """Count each bracket by bucket; put settled ranks into ``found`` and return narrower brackets."""
    entries = []
    for i, b in enumerate(brackets):
        x = quoted(b.name).cast("double")
        held = x.isNotNull() if b.inside is None else x.between(b.low, b.high)
        entries.append(F.when(held, F.struct(F.lit(i).alias("i"), x.alias("x"), _bucket(b, x, few).alias("bucket"))))
    values = df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
    buckets = values.groupBy("i", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    histograms = defaultdict(list)
    for r in buckets.collect():
        histograms[r["i"]].append((r["low"], r["high"], r["n"]))
    out = []
    for i, b in enumerate(brackets):
        before, ranks = b.before, list(b.ranks)
        for low, high, n in sorted(histograms[i]):
            inside = [r for r in ranks if r < before + n]
            ranks = ranks[len(inside):]
            if low == high:
                found.update({(b.name, r): low for r in inside})
            elif inside:
                out.append(_Bracket(b.name, inside, before, n, low, high))
            before += n
    return out
