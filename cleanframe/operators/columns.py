"""Drop, rename and select columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import snake_name
from ..schema import numeric_columns, quoted, text_columns


def drop_columns(df: DataFrame, names) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def effective_renames(names: dict | None) -> dict:
    """Renames that change something: empty and identical new names are ignored."""
    return {old: new for old, new in (names or {}).items() if new and new != old}


def rename_columns(df: DataFrame, names: dict) -> DataFrame:
    return df.withColumnsRenamed(effective_renames(names))


def snake_names(names: list[str]) -> list[str]:
    """Snake-case names; a repeated name gets ``_2``, ``_3`` …"""
    taken: set[str] = set()
    result = []
    for name in names:
        base = snake_name(name)
        unique, n = base, 1
        while unique in taken:
            n += 1
            unique = f"{base}_{n}"
        taken.add(unique)
        result.append(unique)
    return result


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Only the ``numeric`` (booleans excluded) or only the ``text`` columns."""
    names = {"numeric": numeric_columns, "text": text_columns}[kind](df)
    return df.select(*[quoted(n) for n in names])
