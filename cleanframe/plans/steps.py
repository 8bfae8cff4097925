"""Typed steps of a run. Each selects its own columns, changes the table and logs what it did.

A step sees the table as the steps before it left it, so names are those after renaming;
columns the table does not have are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vocabulary import label
from ..operators.columns import drop_columns, effective_renames, snake_names
from ..operators.impute import ORDERED, STATIC, apply_fills, null_counts, plan_one_method
from ..operators.kinds import convert_type, convert_types, invalid_counts
from ..operators.outliers import apply_actions, outlier_bounds, removal
from ..operators.profile import outlier_counts
from ..operators.rows import (
    apply_filters, columns_above_null_share, drop_duplicates, drop_duplicates_on, drop_null_rows, drop_repeated,
)
from ..operators.text import standardise_text
from ..schema import dtype_of, numeric_columns, quoted, text_columns
from ..session import write_table
from .log import Counted, Log, format_number


@dataclass
class Run:
    """The table on its way through the steps, and what is known about it."""

    rows: DataFrame
    row_id: str | None = None
    order_by: list | None = None
    partition_by: list[str] | None = None
    materialise: bool = True
    log: Log = field(default_factory=Log)
    settled: bool = False

    def present(self, names: Iterable[str] | None) -> list[str]:
        have = set(self.rows.columns)
        return [n for n in names or () if n in have]

    def settle(self, purpose: str) -> None:
        """Write the table once, before the first step that reads statistics from it."""
        if self.materialise and not self.settled:
            self.rows = write_table(self.rows, purpose)
            self.settled = True

    def change(self, rows: DataFrame) -> None:
        self.rows, self.settled = rows, False

    def row_count(self) -> Callable[[], int]:
        """Rows at this point of the plan, counted in passing while the table is written.

        Without a written table the count is a pass of its own. Observed counts are exact
        where no shuffle lies between this point and the write: tasks of the writing stage
        are counted once even if executors are lost.
        """
        if not self.materialise:
            here = self.rows
            return here.count
        seen = Observation()
        self.rows = self.rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        return lambda: seen.get["rows"]


@dataclass
class DropColumns:
    names: list[str]

    def apply(self, run: Run) -> None:
        if gone := run.present(self.names):
            run.change(drop_columns(run.rows, gone))
            run.log.add("drop", None, f"columns dropped: {', '.join(gone)}")


@dataclass
class RenameColumns:
    names: dict[str, str]

    def apply(self, run: Run) -> None:
        wanted = effective_renames(self.names)
        if found := {old: wanted[old] for old in run.present(wanted)}:
            run.change(run.rows.withColumnsRenamed(found))
            run.row_id = found.get(run.row_id, run.row_id)
            run.log.add("rename", None, "columns renamed: " + ", ".join(f"{o} to {n}" for o, n in found.items()))


@dataclass
class SnakeCase:
    def apply(self, run: Run) -> None:
        old = run.rows.columns
        new = snake_names(old)
        run.change(run.rows.toDF(*new))
        run.row_id = dict(zip(old, new)).get(run.row_id, run.row_id)
        run.log.add("snake_case", None, "column names in snake case")


@dataclass
class ConvertColumns:
    targets: dict[str, str]
    decimal_comma: bool = False
    day_first: bool = True
    formats: dict[str, str] = field(default_factory=dict)

    def apply(self, run: Run) -> None:
        source = run.rows
        targets = {n: self.targets[n] for n in run.present(self.targets)}
        if not targets:
            return
        values = {
            n: convert_type(quoted(n), dtype_of(source, n), t, self.decimal_comma, self.day_first, self.formats.get(n))
            for n, t in targets.items()
        }
        lost = Counted(lambda: invalid_counts(source, values), "column", "invalid")
        for n, t in targets.items():
            run.log.add("convert", n, f"converted to {label(t)}, invalid values became null", lost.later(n))
        run.change(convert_types(source, targets, self.decimal_comma, self.day_first, self.formats))


@dataclass
class StandardiseText:
    """Only columns that still are text after the conversions."""

    columns: list[str]
    options: dict = field(default_factory=dict)

    def apply(self, run: Run) -> None:
        still_text = set(text_columns(run.rows))
        if chosen := [n for n in run.present(self.columns) if n in still_text]:
            run.change(standardise_text(run.rows, chosen, **self.options))
            run.log.add("text", None, f"text standardised in {len(chosen)} column(s)")


@dataclass
class RemoveDuplicates:
    subset: list[str] | None = None
    keep: str | bool = "first"

    def apply(self, run: Run) -> None:
        source, subset = run.rows, run.present(self.subset)
        if self.keep in (False, "none"):
            run.change(drop_repeated(source, subset or [n for n in source.columns if n != run.row_id]))
        elif subset:
            if not run.order_by:
                raise ValueError("keeping the first or last duplicate needs order_by or row_id")
            run.change(drop_duplicates_on(source, subset, run.order_by, self.keep))
        else:
            run.change(drop_duplicates(source, run.row_id))
        left = run.row_count()
        # The rows before it are on the far side of the shuffle: counting them reads no column
        run.log.add("dedup", None, "duplicate rows removed", lambda: source.count() - left())
        run.settle("distinct")


@dataclass
class RequireValues:
    columns: list[str]

    def apply(self, run: Run) -> None:
        if not (needed := run.present(self.columns)):
            return
        source = run.rows
        incomplete = reduce(or_, [quoted(n).isNull() for n in needed])
        # A filter over a written table is read with it, so the table stays settled
        run.rows = drop_null_rows(source, needed)
        run.log.add("required", None, f"rows with nulls in {', '.join(needed)} removed", lambda: source.where(incomplete).count())


@dataclass
class DropSparseColumns:
    threshold: float

    def apply(self, run: Run) -> None:
        run.settle("measured")
        if names := [n for n in columns_above_null_share(run.rows, self.threshold) if n != run.row_id]:
            # Leaving columns out of a written table costs nothing: it stays settled
            run.rows = run.rows.drop(*[quoted(n) for n in names])
            run.log.add("drop", None, f"columns above {self.threshold}% nulls dropped: {', '.join(names)}")


@dataclass
class FillNulls:
    columns: list[str]
    method: str
    fixed_value: object = None
    skew_limit: float = 0.5

    def apply(self, run: Run) -> None:
        if not (chosen := run.present(self.columns)):
            return
        run.settle("measured")
        fills = plan_one_method(run.rows, chosen, self.method, self.fixed_value, self.skew_limit)
        ordered = [f.column for f in fills if f.method in ORDERED]
        # Literals over a written table cost nothing to repeat; a fill in row order does
        run.rows = apply_fills(run.rows, fills, run.order_by, run.partition_by)
        if ordered:
            run.settled = False
            run.settle("filled")
        after, left = run.rows, {}

        def filled(f) -> int:
            if not left:
                left.update(null_counts(after, ordered))
            return f.nulls - left[f.column]

        for f in fills:
            if f.method == "skip":
                run.log.add("impute", f.column, f"skipped: {f.reason}", 0)
            elif f.method in STATIC:
                cells = 0 if f.value is None else f.nulls
                run.log.add("impute", f.column, f"{f.method}: {f.reason}", cells, format_number(f.value))
            elif f.method in ORDERED:
                run.log.add("impute", f.column, f.method, lambda f=f: filled(f))


@dataclass
class TreatOutliers:
    columns: list[str]
    method: str = "IQR"
    factor: float = 1.5
    action: str = "remove"

    def apply(self, run: Run) -> None:
        numbers = set(numeric_columns(run.rows))
        if not (chosen := [n for n in run.present(self.columns) if n in numbers]):
            return
        run.settle("measured")
        source, action = run.rows, label(self.action)
        bounds = outlier_bounds(source, chosen, self.method, self.factor)
        found = outlier_counts(source, bounds)
        for n in chosen:
            low, high = bounds[n]
            limits = "no values" if low is None else f"{low:.2f} to {high:.2f}"
            run.log.add("outliers", n, f"{self.method}, limits {limits}, {action}", found[n])
        run.change(apply_actions(source, bounds, dict.fromkeys(chosen, action)))
        if action == "remove":
            run.log.add("remove", None, "rows with outliers removed", lambda: source.where(removal(bounds)).count())


@dataclass
class KeepMatching:
    filters: list[dict]

    def apply(self, run: Run) -> None:
        known = set(run.rows.columns)
        outcome = apply_filters(run.rows, [f for f in self.filters if f["column"] in known])
        removed = Counted(outcome.removed_counts, "filter", "removed")
        for i, (f, condition) in enumerate(zip(outcome.filters, outcome.conditions), start=1):
            what = f"{label(f['operator'])} {f.get('value', '')}".strip()
            if condition is None:
                what = f"skipped, value does not fit the column: {what}"
            run.log.add("filter", f["column"], what, removed.later(i))
        run.change(outcome.df)
