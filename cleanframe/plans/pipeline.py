"""Step-list pipeline: columns, types, text, duplicates, imputation, outliers, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import nan_to_null
from . import steps
from .log import Log
from .steps import Run


def structure_steps(cfg: dict) -> list:
    """Steps that are projections: names, types, text."""
    chosen = [steps.DropColumns(cfg.get("drop_columns") or []), steps.RenameColumns(cfg.get("rename") or {})]
    if cfg.get("snake_case"):
        chosen.append(steps.SnakeCase())
    chosen.append(steps.ConvertColumns(
        cfg.get("conversions") or {}, cfg.get("decimal_comma", False), cfg.get("dayfirst", True), cfg.get("date_formats") or {},
    ))
    chosen.append(steps.StandardiseText(cfg.get("text_columns") or [], cfg.get("text_options") or {}))
    return chosen


def row_steps(cfg: dict) -> list:
    """Steps on whole rows and on their statistics, in their fixed order."""
    chosen, rows = [], cfg.get("dup_null") or {}
    if rows.get("drop_duplicates"):
        chosen.append(steps.RemoveDuplicates(rows.get("dup_subset"), rows.get("keep", "first")))
    chosen.append(steps.RequireValues(rows.get("drop_null_rows_in") or []))
    if rows.get("drop_cols_threshold") is not None:
        chosen.append(steps.DropSparseColumns(rows["drop_cols_threshold"]))
    if cfg.get("impute_columns"):
        chosen.append(steps.FillNulls(
            cfg["impute_columns"], cfg["impute_method"], cfg.get("fixed_value"), cfg.get("skew_limit", 0.5),
        ))
    chosen.append(steps.TreatOutliers(
        cfg.get("outlier_columns") or [], cfg.get("outlier_method", "IQR"), cfg.get("outlier_factor", 1.5),
        cfg.get("outlier_action", "remove"),
    ))
    chosen.append(steps.KeepMatching(cfg.get("filters") or []))
    return chosen


def run_pipeline(
    df: DataFrame, cfg: dict, row_id: str | None = None, order_by: list | None = None,
    partition_by: list[str] | None = None, materialise: bool = True,
) -> tuple[DataFrame, Log]:
    """Apply the steps of ``cfg`` in order. Unknown columns are ignored; steps after the
    renaming use the new names.

    ``order_by`` (default the ``row_id``) is needed by keep first/last on a subset and by
    fills from neighbouring rows.

    With ``materialise`` the table is written to the scratch folder once after the
    duplicates are gone, or before the first statistics, and once more after fills in row
    order. Statistics, counts of the log and the result then read that table, so texts,
    conversions and the shuffle of the duplicates are computed once.
    """
    run = Run(nan_to_null(df), row_id, order_by, partition_by, materialise)
    for step in structure_steps(cfg):
        step.apply(run)
    if not run.order_by and run.row_id:
        run.order_by = [run.row_id]
    for step in row_steps(cfg):
        step.apply(run)
    return run.rows, run.log
