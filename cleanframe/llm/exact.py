"""Exact deduplication by deterministic block naming.

One pass over the texts normalises each, numbers the rows and writes the text as blocks of a fixed
number of bytes. Equal blocks get equal integer names, different blocks different ones, by sorting
the blocks themselves; then adjacent names are paired and the pairs named the same way, until
every text has a single name. No digest decides equality: names come from comparing blocks and
pairs, and rows are told apart by their numbers.

Everything is DataFrame expressions. Naming is one shuffle: a value goes to a fixed bucket, is
sorted there, and bucket number and rank make its name. The thousand most frequent values are
named first and joined by broadcast; any other has less than a thousandth of the rows, so no
bucket receives a hot value.

Defined results: a null text counts as empty, and empty texts are equal. A null id never stays
where the group has another id. Repeated rows are rows of their own: the report lists and counts each of
them, ``keep_first`` leaves one. Other columns pass through untouched, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import drop_table, write_table

from .columns import free_name, with_row_numbers

BLOCK_BYTES = 8192
BUCKETS = 1 << 20
HOT_VALUES = 1000
LEAST_HOT = 2000


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text. Single spaces are not touched."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "), F.lit(""))


def blocks_of(content: str, block: int) -> Column:
    """Slices of a binary column; an empty one has a single empty slice."""
    last = F.floor((F.greatest(F.octet_length(content), F.lit(1)) - 1) / block).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col(content), k * block + 1, F.lit(block)))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with an integer ``name`` in place of ``keys`` and of ``digest``, their 64-bit hash.

    Rows with equal keys, nulls included, and only those get the same name. ``rows`` is read two or
    three times, the first time without the keys.
    """
    rest = [c for c in rows.columns if c not in (*keys, "digest")]
    counts = rows.groupBy("digest").agg(F.count("*").alias("times")).where(F.col("times") > LEAST_HOT)
    hot = [r[0] for r in counts.orderBy(F.desc("times"), "digest").limit(HOT_VALUES).collect()]
    cold = rows.where(~F.col("digest").isin(hot)) if hot else rows
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    cold = cold.withColumn("bucket", F.pmod("digest", F.lit(BUCKETS)))
    out = cold.select(*rest, (F.shiftleft("bucket", 42) + rank).alias("name"))
    if hot:
        warm = rows.where(F.col("digest").isin(hot))
        # Few values however large the table is: one, in practice, for each hot digest.
        values = sorted(warm.select(*keys).distinct().collect(), key=lambda r: tuple((v is None, v) for v in r))
        labelled = [(*r, -1 - i) for i, r in enumerate(values)]
        schema = ", ".join([f"hot_{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["name long"])
        names = F.broadcast(rows.sparkSession.createDataFrame(labelled, schema))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"hot_{k}"))
        out = out.unionByName(warm.join(names, same).select(*rest, "name"))
    return out


def identities(numbered: DataFrame, row: str, id_column: str, text_column: str, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: its number ``row``, ``id``, ``text_sha256``, ``level``, ``name``.

    ``(level, name)`` is equal for two rows exactly when their normalised texts are equal.
    """
    base = numbered.select(quoted(row).alias("row"), quoted(id_column).cast("long").alias("id"), normalised(quoted(text_column)).cast("binary").alias("content"))
    cut = base.select("row", "id", F.sha2("content", 256).alias("text_sha256"), blocks_of("content", block).alias("blocks"))
    rows = cut.select("row", "id", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "content"))
    # Id and digest stand beside the first block only.
    first = {c: F.when(F.col("pos") == 0, F.col(c)) for c in ("id", "text_sha256")}
    rows = write_table(rows.withColumns({**first, "digest": F.xxhash64("content")}), "blocks")
    texts, used, finished = rows, [], []
    level, keys, parts = 0, ["content"], rows.drop("id", "text_sha256")
    while True:
        current = write_table(named(parts, keys), "names")
        used.append(current)
        finished.append(current.where("n = 1").select("row", "name", F.lit(level).alias("level")))
        if current.where("n > 1").isEmpty():
            break
        pairs = current.where("n > 1").groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
            F.shiftright(F.max("n") + 1, 1).alias("n"),
        )
        level, keys = level + 1, ["left", "right"]
        parts = write_table(pairs.withColumn("digest", F.xxhash64(*keys)), "pairs")
        used.append(parts)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    result = write_table(out.join(texts.where("pos = 0").select("row", "id", "text_sha256"), "row"), "identities")
    for part in (texts, *used):
        drop_table(part)
    return result


def groups(ids: DataFrame) -> DataFrame:
    """``ids`` with ``keep_id`` (smallest id of the equal texts), ``keep_row`` (its first row) and ``group_size``."""
    smallest = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row"))
    found = ids.groupBy("level", "name").agg(smallest.alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    # Written so that the join shuffles both sides, and Spark can split the part of a hot group.
    several = write_table(found.select("level", "name", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "groups")
    joined = ids.join(several, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return joined.withColumns({
        "keep_id": F.when(alone, F.col("id")).otherwise(F.col("keep_id")),
        "keep_row": F.when(alone, F.col("row")).otherwise(F.col("keep_row")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
    })


def exact_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``kept`` marks all rows with the smallest id of their group.
    """
    row = free_name(df, "row")
    numbered = df.select(quoted(id_column), quoted(text_column)).withColumn(row, F.monotonically_increasing_id())
    return groups(identities(numbered, row, id_column, text_column)).select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def keep_first(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", stored: bool = False) -> DataFrame:
    """``df`` with one row of each group of equal texts, the first with the smallest id.

    A ``stored`` table, one whose every pass sees the same rows, is copied only if ids are null or repeated.
    """
    numbered, row = with_row_numbers(df, id_column, stored)
    found = groups(identities(numbered, row, id_column, text_column))
    gone = write_table(found.where("row <> keep_row").select(F.col("row").alias(row)), "dropped")
    drop_table(found)
    return numbered.join(gone, row, "left_anti").select(*(quoted(c) for c in df.columns))
