"""Removal of repeated passages with a logarithmic family of sparse suffix indexes.

A passage of ``LEAST`` bytes that starts anywhere else too, in another text or the same, is
repeated; all bytes covered by repeated passages are removed. Of the suffixes of a text those are
indexed that start at an anchor: the place of the smallest ``HEAD``-byte fingerprint in some window
of ``LEAST`` bytes. Equal windows have their anchor at the same place, so no repeated passage is
missed, and about one suffix in 85 is kept. An index level is a table of these suffixes sorted by
the fingerprint of their first bytes, with the smallest and largest occurrence of each.

Batches are added one after the other: each is sorted into an array of its own and merge-scanned
against the levels for suffixes that begin alike; levels of equal size merge, so a suffix is
rewritten a logarithmic number of times. Suffixes that begin alike are then compared over their
whole windows, left and right of the anchor, which decides every window by its own bytes.

Texts that are equal as a whole enter once; if they are long enough each copy is repeated
throughout. Beginnings shared by very many different contexts are compared window by window in
shuffles instead of in one task.

Defined results: a null text counts as empty; texts shorter than ``LEAST`` bytes lose nothing.
Rows repeated with id and text are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import drop_table, ship_package, write_table

from .words import chunks, prefix_sums, span_hash

LEAST = 200
HEAD = 32
BATCHES = 4
HOT_CONTEXTS = 30_000
_PLACE_BITS = 28


def anchors(data: np.ndarray, borders: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, fingerprint): runs of window starts with the same anchor."""
    width = least - HEAD + 1
    n = len(data)
    if n < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n >= 1 << _PLACE_BITS:
        raise ValueError("texts of 256 MB and more are not supported")
    sums = prefix_sums(data)
    at = np.arange(n - HEAD + 1)
    prints = span_hash(sums, at, at + HEAD)
    order = (prints >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    # Sliding minimum: running minima from both ends of blocks of the window's width.
    blocks = -(-len(order) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(order)] = order
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - least + 1
    lowest = np.minimum(back[:count], ahead[width - 1:width - 1 + count])
    place = (lowest & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))[:count]
    valid = np.arange(count) + least <= borders[1:][row]
    starts = np.flatnonzero(valid)
    place, row = place[starts], row[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], place[first], starts[first], starts[last] if len(first) else starts[:0], prints[place[first]]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) to (head, text_key, first): the suffixes of each text."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for start, data, borders in chunks(batch.column(1)):
            row, _, first, _, prints = anchors(data, borders)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints.view(np.int64)), pa.array(keys[start + row]), pa.array(first - borders[row])], ["head", "text_key", "first"])


class SuffixIndexFamily:
    """Levels of sorted suffix tables: ``head``, smallest and largest occurrence."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch of (head, text_key, first); returns its ``head``s that occur again."""
        place = F.xxhash64("text_key", "first")
        array = self._sorted(suffixes.select("head", place.alias("low"), place.alias("high")))
        again = array.where("low <> high").select("head")
        for level in self.levels.values():
            again = again.unionByName(array.join(level.select("head"), "head", "left_semi").select("head"))
        found = write_table(again.distinct(), "repeated")
        size = 0
        while size in self.levels:
            older = self.levels.pop(size)
            merged = self._sorted(array.unionByName(older))
            drop_table(array)
            drop_table(older)
            array, size = merged, size + 1
        self.levels[size] = array
        return found

    def _sorted(self, rows: DataFrame) -> DataFrame:
        one = rows.groupBy("head").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return write_table(one.sortWithinPartitions("head"), "suffixes")

    def drop(self) -> None:
        for level in self.levels.values():
            drop_table(level)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text, firsts) to one row per anchor asked for.

    A row has the head, a digest of the context (all bytes of its windows), the place, and the
    context itself; within a batch equal contexts carry their bytes once, with their number.
    """
    for batch in batches:
        keys, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows: dict[tuple, list] = {}
        heads, contexts, texts, firsts = [], [], [], []
        for start, data, borders in chunks(batch.column(1)):
            row, place, first, last, prints = anchors(data, borders)
            sums = prefix_sums(data)
            digest = span_hash(sums, first, last + LEAST) ^ (np.uint64(0x9E3779B97F4A7C15) * (place - first + 1).astype(np.uint64))
            digest, heads_here = digest.view(np.int64).tolist(), prints.view(np.int64).tolist()
            sets = [set(w) for w in wanted[start:start + len(borders) - 1]]
            for k, (r, a, b) in enumerate(zip(row.tolist(), first.tolist(), last.tolist())):
                at = a - int(borders[r])
                if at not in sets[r]:
                    continue
                heads.append(heads_here[k])
                contexts.append(digest[k])
                texts.append(keys[start + r])
                firsts.append(at)
                known = rows.get((heads_here[k], digest[k]))
                if known:
                    known[1] += 1
                else:
                    rows[(heads_here[k], digest[k])] = [len(heads) - 1, 1, data[a:b + LEAST].tobytes()]
        number, raw = [0] * len(heads), [None] * len(heads)
        for k, n, content in rows.values():
            number[k], raw[k] = n, content
        yield pa.RecordBatch.from_arrays(
            [pa.array(heads, pa.int64()), pa.array(contexts, pa.int64()), pa.array(texts, pa.int64()), pa.array(firsts, pa.int64()),
             pa.array(number, pa.int64()), pa.array(raw, pa.binary())], ["head", "context", "text_key", "first", "n", "content"])


def window_hashes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of some contexts, and the borders by context."""
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    borders = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
    n = np.diff(borders) - LEAST + 1
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(borders[:-1] - ends[:-1], n) + np.arange(ends[-1])
    return span_hash(prefix_sums(data), at, at + LEAST), ends


def _decide(head: int, contexts: dict[int, list]) -> list[tuple]:
    """(head, context, ranges of repeated window starts) of one group of contexts."""
    hashes, ends = window_hashes([c[1] for c in contexts.values()])
    owner = np.repeat(np.arange(len(contexts)), np.diff(ends))
    numbers = np.array([c[0] for c in contexts.values()])
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    several = np.empty(len(order), dtype=bool)
    several[order] = np.bincount(group, weights=numbers[owner[order]])[group] > 1
    out = []
    for k, context in enumerate(contexts):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], several[ends[k]:ends[k + 1]].view(np.int8), [0]])))
        if len(edges):
            out.append((head, context, edges.tolist()))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head: each run of equal heads is one comparison."""
    current, contexts = None, {}
    for batch in batches:
        out = []
        for head, context, n, content in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if head != current:
                if contexts:
                    out += _decide(current, contexts)
                current, contexts = head, {}
            known = contexts.setdefault(context, [0, content])
            known[0] += n
        yield _ranges(out)
    yield _ranges(_decide(current, contexts) if contexts else [])


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], ["head", "context", "edges"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = batch.column(3).to_pylist()
        if contents:
            hashes, ends = window_hashes(contents)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["head", "context", "n", "windows"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text, firsts, edges) to what is left of each text."""
    for batch in batches:
        rows = []
        for key, text, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = (text or "").encode()
            marks = np.zeros(len(raw) + 1, dtype=np.int64)
            for place in places:
                first, edges = place["first"], place["edges"]
                for a, b in zip(edges[::2], edges[1::2]):
                    marks[first + a] += 1
                    marks[first + b - 1 + LEAST] -= 1
            covered = np.cumsum(marks[:-1]) > 0
            spans = int(np.count_nonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8)) == 1))
            kept = np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes()
            rows.append((key, int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["text_key", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", batches: int = BATCHES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``
    (the remaining bytes of rows that lose some; null where nothing or everything goes)."""
    spark = df.sparkSession
    ship_package(spark)
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    base = df.select(quoted(id_column).alias("_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_enough = base.where(F.col("n_bytes") >= LEAST)

    family = SuffixIndexFamily(spark)
    stored = write_table(long_enough.select("text_key", "text").mapInArrow(_suffixes, "head long, text_key long, first long"), "stored")
    repeated = None
    for batch in range(batches):
        found = family.add(stored.where(F.pmod(F.xxhash64("text_key", F.lit(3)), F.lit(batches)) == batch))
        repeated = found if repeated is None else repeated.unionByName(found)
    family.drop()
    # A long run of copies has the same suffixes many times; each text counts once.
    # The heads are written first: the join shuffles both sides, and Spark can split a hot head.
    heads = write_table(repeated.distinct(), "heads")
    wanted = stored.join(heads, "head", "left_semi").groupBy("text_key").agg(F.collect_set("first").alias("firsts"))
    wanted = write_table(wanted, "wanted")
    drop_table(stored)

    groups = write_table(base.groupBy("text_key").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.min("_id").alias("one")), "texts")
    asked = wanted.join(groups.select("text_key", "one"), "text_key")
    active = long_enough.select(F.col("text_key").alias("k"), F.col("_id").alias("i"), "text").join(
        asked, (F.col("k") == F.col("text_key")) & F.col("i").eqNullSafe(F.col("one")))
    active = write_table(active.select("text_key", "text", "firsts"), "active")
    found = write_table(active.mapInArrow(_contexts, "head long, context long, text_key long, first long, n long, content binary"), "contexts")
    contents = found.where("content is not null").select("head", "context", "n", "content")
    hot = write_table(contents.groupBy("head").agg(F.count("*").alias("m")).where(F.col("m") > hot_contexts).select("head"), "hot")
    normal = contents.join(hot, "head", "left_anti")
    decided = normal.repartition("head").sortWithinPartitions("head").mapInArrow(_compare, "head long, context long, edges array<long>")
    windows = contents.join(hot, "head", "left_semi").mapInArrow(_windows, "head long, context long, n long, windows array<long>")
    windows = write_table(windows.select("head", "context", "n", F.posexplode("windows").alias("at", "window")), "windows")
    several = write_table(windows.groupBy("head", "window").agg(F.sum("n").alias("n")).where("n > 1").select("head", "window"), "several")
    crowded = windows.join(several, ["head", "window"]).groupBy("head", "context").agg(F.array_sort(F.collect_set(F.col("at").cast("long"))).alias("at"))
    crowded = crowded.select("head", "context", F.expr("flatten(transform(at, x -> array(x, x + 1)))").alias("edges"))
    ranges = write_table(decided.unionByName(crowded), "ranges")
    places = found.select("head", "context", "text_key", "first").join(ranges, ["head", "context"])
    places = places.groupBy("text_key").agg(F.collect_list(F.struct("first", "edges")).alias("places"))
    left = active.select("text_key", "text").dropDuplicates(["text_key"]).join(places, "text_key").select("text_key", "text", "places")
    left = write_table(left.mapInArrow(_removed, "text_key long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "left")

    known = write_table(groups.join(left, "text_key", "left").where("copies > 1 or n_removed is not null").select("text_key", "copies", "n_removed", "n_spans", "kept_sha256", "kept"), "known")
    out = base.select("_id", "text_key", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("own")).join(known, "text_key", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LEAST)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        F.col("_id").alias(id_column), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.when(~F.coalesce(copied, F.lit(False)), F.col("kept")).alias("kept"),
    )
