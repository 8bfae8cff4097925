"""The full run: prepare, treat, profile, counters and change tracking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changes import changed_cells, changed_rows
from ..operators.profile import full_profile, quality
from ..schema import quoted
from ..session import write_table
from .log import Log
from .prepare import Prepared, prepare
from .treat import Treated, treat


@dataclass
class Cleaned:
    """Everything a full run offers; all of it is lazy but the statistics."""

    raw: DataFrame
    prepared: Prepared
    treated: Treated
    row_id: str
    rename: dict
    iqr_factor: float
    duplicates: int | None = None

    @property
    def df(self) -> DataFrame:
        """The cleaned table without the row id."""
        return self.treated.df.drop(quoted(self.row_id))

    @property
    def log(self) -> Log:
        return Log(self.prepared.log.entries + self.treated.log.entries)

    def log_frame(self, only_effective: bool = True) -> DataFrame:
        return self.log.frame(self.raw.sparkSession, only_effective)

    def profile(self) -> DataFrame:
        """Profile of the prepared table, null patterns in source order."""
        kinds = {n: k for n, k in self.prepared.kinds.items()}
        return full_profile(self.prepared.df, kinds, self.iqr_factor, [self.row_id])

    def changed(self) -> DataFrame:
        """The result with a ``<name>_changed`` flag per column and the imputed flags."""
        return changed_cells(self.raw, self.treated.rows, self.row_id, self.prepared.kinds, self.rename)

    def preview(self, only_changed: bool = False, limit: int = 1000) -> DataFrame:
        return changed_rows(self.changed(), self.row_id, only_changed, limit)

    def duplicates_removed(self) -> int:
        if self.duplicates is None:
            self.duplicates = self.prepared.duplicates_removed()
        return self.duplicates

    def summary(self) -> DataFrame:
        """One row: duplicates removed, cells imputed, outliers found, columns with
        problems, quality before and after."""
        outliers = F.coalesce(F.col("outliers"), F.lit(0))
        found = self.profile().agg(
            F.sum(outliers).alias("outliers"), F.count_if((F.col("nulls") > 0) | (outliers > 0)).alias("problem_columns")
        )
        before = quality(self.prepared.df.drop(quoted(self.row_id))).withColumnRenamed("quality", "quality_before")
        after = quality(self.df).withColumnRenamed("quality", "quality_after")
        # Single-row tables side by side
        return found.select(
            F.lit(self.duplicates_removed()).cast("long").alias("duplicates"),
            F.lit(self.treated.counters()["imputed"]).cast("long").alias("imputed"),
            "outliers", "problem_columns",
            before.scalar().alias("quality_before"), after.scalar().alias("quality_after"),
        )


def clean(
    raw: DataFrame, prepare_cfg: dict | None = None, treat_cfg: dict | None = None,
    row_id: str = "row_id", materialise: bool = True,
) -> Cleaned:
    """Prepare and treat ``raw``, which carries a unique ``row_id`` in source order.

    With ``materialise`` the prepared table is written once to the scratch folder, so the
    statistics passes read only their columns instead of repeating text work and
    deduplication.
    """
    prepare_cfg, treat_cfg = prepare_cfg or {}, treat_cfg or {}
    prepared = prepare(raw, prepare_cfg, row_id)
    if materialise:
        prepared.df = write_table(prepared.df, "prepared")
    treated = treat(prepared.df, treat_cfg, prepared.kinds, row_id)
    return Cleaned(raw, prepared, treated, row_id, prepare_cfg.get("rename") or {}, treat_cfg.get("iqr_factor", 1.5))
