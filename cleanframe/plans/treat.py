"""Statistical treatment: required values, outliers, imputation, filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import NUMERIC, label
from ..operators.impute import ORDERED, STATIC, Fill, apply_fills, imputed_mask, plan_fills
from ..operators.outliers import Bounds, apply_actions, outlier_bounds
from ..operators.profile import outlier_counts
from ..operators.rows import Filtered, apply_filters, drop_null_rows
from ..schema import dtype_of, is_numeric, nan_to_null, quoted
from .log import Counted, Log, format_number


@dataclass
class Treated:
    """``rows`` holds the data and one ``<name>_imputed`` flag per filled column."""

    rows: DataFrame
    columns: list[str]
    fills: list[Fill]
    bounds: Bounds
    outliers: int
    log: Log = field(default_factory=Log)
    unfiltered: DataFrame | None = None
    filtered: Filtered | None = None

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*[quoted(n) for n in self.columns])

    def log_frame(self, only_effective: bool = False) -> DataFrame:
        return self.log.frame(self.rows.sparkSession, only_effective)

    def counters(self) -> dict[str, int]:
        """Cells imputed, outliers found, rows removed by outliers and filters."""
        imputed = sum(e.count() or 0 for e in self.log.entries if e.operation == "impute")
        removed = sum(e.count() or 0 for e in self.log.entries if e.operation in ("remove", "filter"))
        return {"imputed": imputed, "outliers": self.outliers, "rows_removed": removed}


def treat(
    df: DataFrame, cfg: dict | None, kinds: dict[str, str], row_id: str | None = None,
    order_by: list | None = None, partition_by: list[str] | None = None,
) -> Treated:
    """Treat a prepared table.

    ``cfg`` keys: ``drop_null_rows``, ``columns`` (``{name: {outliers, impute}}``),
    ``iqr_factor``, ``skew_limit``, ``filters``. Bounds come from the table before any
    outlier is removed, fill values from the table after; each is a fixed number of jobs
    whatever the number of columns. Ordered fills follow ``order_by``, else ``row_id``.
    """
    cfg, log = cfg or {}, Log()
    df = nan_to_null(df)
    columns = df.columns
    order_by = order_by or ([row_id] if row_id else None)
    choices = cfg.get("columns", {})

    required = [c for c in cfg.get("drop_null_rows", []) if c in columns]
    if required:
        source = df
        df = drop_null_rows(df, required)
        kept = df
        log.add("required", None, f"rows with nulls in {', '.join(required)} removed", lambda: source.count() - kept.count())

    actions = {
        n: label(choices[n].get("outliers") or "keep")
        for n in columns
        if n in choices and kinds.get(n) == NUMERIC and is_numeric(dtype_of(df, n))
    }
    actions = {n: a for n, a in actions.items() if a != "keep"}
    bounds = outlier_bounds(df, list(actions), "IQR", cfg.get("iqr_factor", 1.5)) if actions else {}
    found = outlier_counts(df, bounds) if bounds else {}
    # Columns without outliers drop out: nothing to clip, null or remove
    actions = {n: a for n, a in actions.items() if found[n]}
    wording = {
        "clip": "outliers limited to {0:.2f} to {1:.2f}", "null": "outliers replaced by null",
        "remove": "rows with an outlier marked for removal",
    }
    for n, action in actions.items():
        log.add("outliers", n, wording[action].format(*bounds[n]), found[n])
    before_removal = df
    df = apply_actions(df, bounds, actions)
    if "remove" in actions.values():
        after_removal = df
        log.add("remove", None, "rows with outliers removed", lambda: before_removal.count() - after_removal.count())

    chosen = {n: c.get("impute") for n, c in choices.items() if n in columns}
    data = df if row_id is None else df.drop(quoted(row_id))
    fills = plan_fills(data, kinds, chosen, cfg.get("skew_limit", 0.5))
    active = [f for f in fills if f.method in ORDERED or (f.method in STATIC and f.value is not None)]
    if active:
        df = df.withColumns({f"__null_{f.column}": quoted(f.column).isNull() for f in active})
        df = apply_fills(df, active, order_by, partition_by)
        masks = {f"{f.column}_imputed": imputed_mask(f"`__null_{f.column}`", quoted(f.column)) for f in active}
        df = df.withColumns(masks).drop(*[f"__null_{f.column}" for f in active])
    unfiltered = df
    masked = Counted(lambda: _mask_counts(unfiltered, active), "column", "cells")
    for f in active:
        cells = f.nulls if f.method in STATIC else masked.later(f.column)
        log.add("impute", f.column, f"{f.method}: {f.reason}", cells, format_number(f.value))

    filtered = apply_filters(df, [f for f in cfg.get("filters", []) if f["column"] in columns])
    removed = Counted(filtered.removed_counts, "filter", "removed")
    for i, f in enumerate(filtered.filters):
        skipped = "skipped, value does not fit the column: " if filtered.conditions[i] is None else ""
        log.add("filter", f["column"], f"{skipped}{label(f['operator'])} {f.get('value', '')}".strip(), removed.later(i + 1))
    return Treated(filtered.df, columns, fills, bounds, sum(found.values()), log, unfiltered, filtered=filtered)


def _mask_counts(df: DataFrame, fills: list[Fill]) -> DataFrame:
    counts = df.agg(*[F.count_if(quoted(f"{f.column}_imputed")).alias(f"c{i}") for i, f in enumerate(fills)])
    rows = [F.struct(F.lit(f.column).alias("column"), F.col(f"c{i}").alias("cells")) for i, f in enumerate(fills)]
    return counts.select(F.inline(F.array(*rows)))
