"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform random permutation sends from each source block to each target a number of rows that
follows the multivariate hypergeometric law. The matrix of these numbers is drawn first, exactly,
by halving the blocks again and again and splitting the capacities of the targets between the
halves. Each block then permutes its rows and deals them out by its line of the matrix, and each
target permutes what it received. Targets are fine parts of the shards, of sizes known beforehand,
so the place of a row in its shard needs no further counting.

Rows are numbered and written once, so blocks stay the same when tasks run again. Blocks and fine
parts are about as many as the cube root of the rows: each holds a small share of any table, and
the matrix stays far smaller than the table. Nothing depends on the values of a row, so hot keys,
nulls, ties and repeated rows are spread like any others. Only DataFrame expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import write_table


def hypergeometric(population: str, good: str, sample: str, u: str) -> str:
    """SQL for a hypergeometric draw: how many of ``good`` are among ``sample`` of ``population``.

    Probabilities relative to the mode are walked up and down from it until they vanish, so no
    factorials are needed; ``u`` in (0, 1) picks a place in their running sum.
    """
    lowest = f"greatest(0L, {sample} - ({population} - {good}))"
    highest = f"least({good}, {sample})"
    centre = f"(double({sample}) + 1) * (double({good}) + 1) / (double({population}) + 2)"
    mode = f"least({highest}, greatest({lowest}, bigint(floor({centre}))))"
    share = f"(double({good}) / greatest(1D, double({population})))"
    spread = f"sqrt(double({sample}) * {share} * (1 - {share}))"
    steps = f"sequence(1L, greatest(1L, least(bigint(ceil(12 * {spread})) + 30L, {highest} - {lowest})))"
    others = f"{population} - {good} - {sample}"
    up = f"if(s.up < {highest}, s.up_w * double({good} - s.up) * double({sample} - s.up) / (double(s.up + 1) * double({others} + s.up + 1)), 0D)"
    down = f"if(s.down > {lowest}, s.down_w * double(s.down) * double({others} + s.down) / (double({good} - s.down + 1) * double({sample} - s.down + 1)), 0D)"
    step = (
        f"(s, i) -> element_at(transform(array(named_struct('a', {up}, 'b', {down})), w -> named_struct("
        "'up', s.up + 1, 'up_w', w.a, 'down', s.down - 1, 'down_w', w.b, 'sum', s.sum + w.a + w.b, 'target', s.target, "
        "'at', if(s.done, s.at, if(s.target <= s.sum + w.a, s.up + 1, if(s.target <= s.sum + w.a + w.b, s.down - 1, s.at))), "
        "'done', s.done or s.target <= s.sum + w.a + w.b)), 1)"
    )

    def walk(target: str, result: str) -> str:
        start = f"named_struct('up', {mode}, 'up_w', 1D, 'down', {mode}, 'down_w', 1D, 'sum', 1D, 'target', {target}, 'at', {mode}, 'done', {target} <= 1D)"
        return f"aggregate({steps}, {start}, {step}, s -> s.{result})"

    return walk(f"{u} * {walk('0D', 'sum')}", "at")


def communication_matrix(sizes: DataFrame, blocks: int, capacities: str, seed: int) -> DataFrame:
    """(``block``, ``counts``): rows each of ``blocks`` (a power of two) sends to each target.

    ``sizes`` has ``block`` and ``n``; ``capacities`` is SQL for the array of target sizes.
    The first three levels, seven draws of a line, are one task; from there on the nodes of
    every third level are dealt out to as many tasks as there are nodes.
    """
    found = sizes.agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("m"))
    nodes = found.select(
        F.lit(0).cast("long").alias("block"),
        F.expr(f"transform(sequence(0L, {blocks - 1}L), b -> coalesce(element_at(m, b), 0L))").alias("sizes"),
        F.expr(capacities).alias("counts"),
    )
    u = f"((double(shiftrightunsigned(xxhash64({seed}, block, size(sizes), size(acc.got)), 12)) + 0.5D) / 4503599627370496D)"
    draw = hypergeometric("acc.population", "c", "acc.sample", u)
    deal = (
        "aggregate(counts, named_struct('got', cast(array() as array<bigint>), 'population', total, 'sample', left_rows), "
        f"(acc, c) -> element_at(transform(array({draw}), x -> named_struct('got', concat(acc.got, array(x)), "
        "'population', acc.population - c, 'sample', acc.sample - x)), 1), acc -> acc.got)"
    )
    for level in range(int(math.log2(blocks))):
        half = blocks >> (level + 1)
        nodes = nodes.withColumns({
            "total": F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"),
            "left_rows": F.expr(f"aggregate(slice(sizes, 1, {half}), 0L, (a, x) -> a + x)"),
        }).withColumn("left", F.expr(deal))
        first = F.struct("block", F.slice("sizes", 1, half).alias("sizes"), F.col("left").alias("counts"))
        second = F.struct(
            (F.col("block") + half).alias("block"), F.slice("sizes", half + 1, half).alias("sizes"),
            F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"),
        )
        nodes = nodes.select(F.inline(F.array(first, second)))
        if level % 3 == 2 and half > 1:  # keeps the plan of one job short, and spreads its nodes over tasks
            nodes = write_table(nodes, "matrix").repartition(2 << level, "block")
    return nodes.select("block", "counts")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    A uniform random permutation cut into shards whose row counts differ by one at most. The
    columns of ``df`` are written once to the scratch folder, whole; select what the shards are
    to hold. An empty table gives an empty result. ``df`` must not have columns of the names
    added here.
    """
    rows = write_table(df.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    n = rows.count()
    root = max(1.0, n ** (1 / 3))
    blocks = 1 << math.ceil(math.log2(root))
    parts = 1 << max(0, math.ceil(math.log2(root / shards)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(blocks)))
    rows = rows.withColumns({"_first": F.xxhash64(F.lit(seed + 1), "_row"), "_second": F.xxhash64(F.lit(seed + 2), "_row")})
    shard_rows = f"({n}L div {shards} + if(t div {parts} < {n}L % {shards}, 1, 0))"
    capacities = (
        f"transform(sequence(0, {shards * parts - 1}), t -> {shard_rows} div {parts} + if(t % {parts} < {shard_rows} % {parts}, 1L, 0L))"
    )
    sizes = rows.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n"))
    matrix = write_table(communication_matrix(sizes, blocks, capacities, seed), "matrix")
    # Ranges of ranks by target, cut at every ``width`` ranks so that a rank meets about two.
    width = max(1, n // (blocks * shards * parts))
    ranges = matrix.select("block", F.posexplode("counts").alias("target", "n"), F.expr(
        "aggregate(counts, named_struct('at', 0L, 'ends', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + x, 'ends', concat(a.ends, array(a.at + x))), a -> a.ends)"
    ).alias("ends")).where("n > 0").select("block", "target", (F.col("ends")[F.col("target")] - F.col("n")).alias("start"), F.col("ends")[F.col("target")].alias("end"))
    ranges = ranges.select("*", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("piece"))
    ranges = write_table(ranges.select(*(F.col(c).alias(f"_range_{c}") for c in ranges.columns)), "ranges")
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_first", "_row")) - 1
    dealt = rows.withColumn("_rank", rank.cast("long")).withColumn("_piece", F.expr(f"_rank div {width}"))
    here = (F.col("_block") == F.col("_range_block")) & (F.col("_piece") == F.col("_range_piece"))
    dealt = dealt.join(ranges, here & (F.col("_rank") >= F.col("_range_start")) & (F.col("_rank") < F.col("_range_end")))
    place = F.row_number().over(Window.partitionBy("_range_target").orderBy("_second", "_row")) - 1
    rows_of = shard_rows.replace("t div", "_range_target div")
    begin = F.expr(f"(_range_target % {parts}) * ({rows_of} div {parts}) + least(_range_target % {parts}, {rows_of} % {parts})")
    return dealt.withColumn("_place", place).select(
        *(quoted(c) for c in df.columns), F.expr(f"int(_range_target div {parts})").alias("shard"), (begin + F.col("_place")).cast("long").alias("slot"),
    )


def sized(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``size`` (UTF-8 bytes of the text plus 1; a null text has none) and ``text_crc32``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return df.select(
        F.col(id_column), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
