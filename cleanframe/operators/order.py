"""Operators that depend on row order: dense positions, fills and interpolation.

A window without keys would move the whole table into one task, and a window by key
would do so with the rows of a hot key. Both are avoided in the same way: the table is
cut into *chunks* that follow the order, each chunk is handled on its own, and what has
to cross a chunk border is carried over in a table with about one row per chunk. Only places
and row counts, numbers of a fixed size, are put in order there; the values stay in a table
with the ends of each chunk and are fetched from it by joins on the chunk.

Chunk borders come from a range partitioning, whose sampled borders differ from run to
run; so the cut table is written once to the scratch folder and every later step reads
that one copy. A table that already has a dense position (``position=``) needs no cut and
no copy: its chunk is the position divided by the chunk size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_even
from ..schema import dtype_of, is_integral, quoted
from ..session import write_table

CHUNK, INDEX = "__chunk", "__index"
ROWS_PER_CHUNK = 500_000
# A table with one row per chunk is broadcast up to this many chunks, joined beyond it
BROADCAST_CHUNKS = 100_000
_INDEX_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in 33 bits


@dataclass
class Chunks:
    """A table cut along its order: chunk number, and index that grows inside each chunk."""

    df: DataFrame
    count: int | None
    keys: list[str]
    dense: bool  # the index is already a position over the whole table

    def small(self, table: DataFrame) -> DataFrame:
        """Hint for a table with a few rows per chunk."""
        if self.count is not None and self.count <= BROADCAST_CHUNKS:
            return F.broadcast(table)
        return table


def cut(
    df: DataFrame, order_by: list, partition_by: list[str] | None = None,
    chunks: int | None = None, position: str | None = None, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> Chunks:
    """Cut ``df`` into chunks along ``partition_by`` then ``order_by`` (a unique order)."""
    keys = list(partition_by or [])
    if position is not None and not keys:
        place = quoted(position)
        chunk = F.floor(place / F.lit(rows_per_chunk))
        return Chunks(df.withColumns({CHUNK: chunk, INDEX: place.cast("long")}), None, keys, True)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = chunks or max(least, -(-df.select().count() // rows_per_chunk))
    order = [quoted(k) for k in keys] + [quoted(o) if isinstance(o, str) else o for o in order_by]
    sorted_parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = sorted_parts.withColumns({
        CHUNK: F.spark_partition_id().cast("long"),
        INDEX: F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX_BITS)),
    })
    return Chunks(write_table(numbered, "chunks"), n, keys, False)


def _offsets(chunks: Chunks) -> DataFrame:
    """Rows before each chunk. The running sum is over one row per chunk."""
    sizes = chunks.df.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(CHUNK, F.coalesce(before, F.lit(0)).alias("__before"), "__size")


def with_position(
    df: DataFrame, order_by: list, name: str = "position", chunks: int | None = None
) -> DataFrame:
    """Add the dense position (from 0) of every row in the given unique order."""
    parts = cut(df, order_by, chunks=chunks)
    placed = parts.df.join(parts.small(_offsets(parts)), CHUNK)
    return placed.withColumn(name, F.col("__before") + F.col(INDEX)).drop(CHUNK, INDEX, "__before", "__size")


def _carried(chunks: Chunks, methods: dict[str, str]) -> DataFrame:
    """Per chunk, an array ``__hand`` of what the chunks before and after it hand over.

    With keys only the first and the last key of a chunk can continue elsewhere, so the
    array has at most two entries.
    """
    t, keys = chunks.df, [quoted(k) for k in chunks.keys]
    named = [k.alias(f"__k{j}") for j, k in enumerate(keys)]
    measures = [F.min(INDEX).alias("__first"), F.max(INDEX).alias("__last")]
    for i, (name, method) in enumerate(methods.items()):
        seen = F.when(quoted(name).isNotNull(), F.col(INDEX))
        if method != "backward":
            measures += [F.max(seen).alias(f"__prev_at{i}"), F.max_by(quoted(name), seen).alias(f"__prev_v{i}")]
        if method != "forward":
            measures += [F.min(seen).alias(f"__next_at{i}"), F.min_by(quoted(name), seen).alias(f"__next_v{i}")]
    ends = t.groupBy(CHUNK, *named).agg(*measures)
    if chunks.keys:
        span = t.groupBy(CHUNK).agg(F.min(INDEX).alias("__from"), F.max(INDEX).alias("__to"))
        ends = ends.join(chunks.small(span), CHUNK).where("__first = __from or __last = __to")
    if chunks.dense:
        ends = ends.withColumn("__before", F.lit(0).cast("long"))
    else:
        ends = ends.join(chunks.small(_offsets(chunks).drop("__size")), CHUNK)
    ends = write_table(ends, "ends")

    names = [f"__k{j}" for j in range(len(keys))]
    before = Window.partitionBy(*names).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*names).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    sides = [(side, i) for i in range(len(methods)) for side in ("prev", "next") if f"__{side}_at{i}" in ends.columns]
    places = [
        F.last(
            F.when(F.col(f"__{side}_at{i}").isNotNull(), F.struct((F.col("__before") + F.col(f"__{side}_at{i}")).alias("at"), F.col(CHUNK).alias("chunk"))),
            ignorenulls=True,
        ).over(before if side == "prev" else after).alias(f"__{side}{i}")
        for side, i in sides
    ]
    found = ends.select(CHUNK, *names, "__before", *places)
    for side, i in sides:
        place, from_ = f"__{side}{i}", [F.col(k).alias(f"__from{j}") for j, k in enumerate(names)]
        values = ends.where(F.col(f"__{side}_at{i}").isNotNull()).select(F.col(CHUNK).alias("__from"), *from_, F.col(f"__{side}_v{i}").alias("__v"))
        match = F.col(f"{place}.chunk") == F.col("__from")
        for j, k in enumerate(names):
            match = match & F.col(k).eqNullSafe(F.col(f"__from{j}"))
        found = found.join(values, match, "left").withColumn(
            place, F.when(F.col("__from").isNotNull(), F.struct(F.col(f"{place}.at").alias("at"), F.col("__v").alias("v"))))
        found = found.drop("__from", "__v", *(f"__from{j}" for j in range(len(names))))
    # At most two entries a chunk
    return found.groupBy(CHUNK).agg(F.collect_list(F.struct(*names, "__before", *(f"__{side}{i}" for side, i in sides))).alias("__hand"))


def fill_ordered(
    df: DataFrame, methods: dict[str, str], order_by: list | None = None, partition_by: list[str] | None = None,
    chunks: int | None = None, position: str | None = None, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Fill nulls from neighbouring rows: ``forward``, ``backward`` or ``interpolate`` per column.

    ``order_by`` must be a unique order. Interpolation is linear by row position; nulls at
    the ends take the nearest value, and integers round half to even.
    """
    if not methods:
        return df
    if not order_by and position is None:
        raise ValueError("ordered fills need order_by or position")
    parts = cut(df, order_by or [], partition_by, chunks, position, rows_per_chunk)
    names = list(methods)
    keys = [quoted(k) for k in parts.keys]
    unknown = set(methods.values()) - {"forward", "backward", "interpolate"}
    if unknown:
        raise ValueError(f"unknown ordered fill: {min(unknown)!r}")

    # One shuffle by chunk serves the windows and the join
    rows = parts.df.repartition(F.col(CHUNK))
    here = [F.col(CHUNK), *keys]
    back = Window.partitionBy(*here).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    # The mirrored order keeps the frame growing; a frame to the end would be quadratic
    ahead = Window.partitionBy(*here).orderBy(F.col(INDEX).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def own_key(entry: Column) -> Column:
        same = F.lit(True)
        for j, k in enumerate(keys):
            same = same & entry[f"__k{j}"].eqNullSafe(k)
        return same

    hand = F.get(F.filter("__hand", own_key), F.lit(0))
    # Positions only matter relative to rows of the same key; a key that is inside one chunk
    # has no entry, and any common offset will do
    before = F.coalesce(hand["__before"], F.lit(0))
    extra, result = {}, {}
    for i, name in enumerate(names):
        c, method = quoted(name), methods[name]
        if method == "forward":
            extra[f"__p{i}"] = F.last(c, ignorenulls=True).over(back)
            result[name] = F.coalesce(F.col(f"__p{i}"), hand[f"__prev{i}"]["v"])
        elif method == "backward":
            extra[f"__n{i}"] = F.last(c, ignorenulls=True).over(ahead)
            result[name] = F.coalesce(F.col(f"__n{i}"), hand[f"__next{i}"]["v"])
        else:
            point = F.when(c.isNotNull(), F.struct(F.col(INDEX).alias("at"), c.alias("v")))
            extra[f"__p{i}"] = F.last(point, ignorenulls=True).over(back)
            extra[f"__n{i}"] = F.last(point, ignorenulls=True).over(ahead)
            result[name] = _between(
                c, dtype_of(df, name), before + F.col(INDEX), before,
                F.col(f"__p{i}"), hand[f"__prev{i}"], F.col(f"__n{i}"), hand[f"__next{i}"],
            )
    filled = rows.withColumns(extra).join(_carried(parts, methods), CHUNK, "left").withColumns(result)
    return filled.select(*[quoted(n) for n in df.columns])


def _between(c, dtype, at, before, near_prev, far_prev, near_next, far_next) -> Column:
    pa = F.coalesce(before + near_prev["at"], far_prev["at"])
    pv = F.coalesce(near_prev["v"], far_prev["v"]).cast("double")
    na = F.coalesce(before + near_next["at"], far_next["at"])
    nv = F.coalesce(near_next["v"], far_next["v"]).cast("double")
    line = pv + (nv - pv) * F.try_divide(at - pa, na - pa)
    value = F.coalesce(line, pv, nv)
    if is_integral(dtype):
        value = round_half_even(value)
    return F.coalesce(c, value.cast(dtype))
