"""Names of helper columns, and numbers of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import write_table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_numbers(df: DataFrame, id_column: str, stored: bool) -> tuple[DataFrame, str]:
    """``df`` with a number of each row that every pass sees alike, and the number's free name.

    Of a ``stored`` table, one whose every pass sees the same rows, the ids are the numbers if none is
    null or repeated, and nothing is copied. Else a copy is written: ids may be null or repeated, and
    numbers given in passing differ from pass to pass.
    """
    row = free_name(df, "row")
    number = quoted(id_column).cast("long")
    if stored and df.groupBy(number.alias(row)).count().where(quoted(row).isNull() | (F.col("count") > 1)).isEmpty():
        return df.withColumn(row, number), row
    return write_table(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
