"""CSV and JSON writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import quoted

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """CSV parts with a header; nested columns as JSON text."""
    if sep not in (",", ";"):
        raise ValueError(f"separator must be ',' or ';', not {sep!r}")
    nested = {f.name: F.to_json(quoted(f.name)) for f in df.schema.fields if isinstance(f.dataType, _NESTED)}
    flat = df.withColumns(nested) if nested else df
    flat.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with ISO dates; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
