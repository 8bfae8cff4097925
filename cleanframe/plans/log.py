"""Operation log whose counts are taken only when the log is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import small_frame

LOG_SCHEMA = pa.schema([
    ("step", pa.int32()), ("operation", pa.string()), ("column", pa.string()),
    ("detail", pa.string()), ("n_cells", pa.int64()), ("value", pa.string()),
])


def format_number(value) -> str | None:
    """Fill value as shown in the log: at most two decimals."""
    if value is None:
        return None
    if isinstance(value, float):
        return f"{value:.2f}".rstrip("0").rstrip(".")
    return str(value)


@dataclass
class Entry:
    operation: str
    column: str | None
    detail: str
    n_cells: int | Callable[[], int] | None = None
    value: str | None = None

    def count(self) -> int | None:
        if callable(self.n_cells):
            self.n_cells = self.n_cells()
        return self.n_cells


@dataclass
class Log:
    entries: list[Entry] = field(default_factory=list)

    def add(self, operation: str, column: str | None, detail: str, n_cells=None, value: str | None = None) -> None:
        self.entries.append(Entry(operation, column, detail, n_cells, value))

    def frame(self, spark: SparkSession, only_effective: bool = False) -> DataFrame:
        """Rows ``(step, operation, column, detail, n_cells, value)``.

        ``only_effective`` hides counted steps that touched nothing.
        """
        rows = [
            {"step": i + 1, "operation": e.operation, "column": e.column, "detail": e.detail, "n_cells": e.count(), "value": e.value}
            for i, e in enumerate(self.entries)
        ]
        if only_effective:
            rows = [r for r in rows if r["n_cells"] is None or r["n_cells"] > 0]
        return small_frame(spark, rows, LOG_SCHEMA)


class Counted:
    """Counts of one small aggregate, run at most once and shared by several entries."""

    def __init__(self, frame: Callable[[], DataFrame], key: str, value: str):
        self._frame, self._key, self._value = frame, key, value
        self._rows: dict | None = None

    def __getitem__(self, key) -> int:
        if self._rows is None:
            self._rows = {r[self._key]: r[self._value] for r in self._frame().collect()}
        return self._rows.get(key, 0)

    def later(self, key) -> Callable[[], int]:
        return lambda: self[key]
