"""Near copies by a chosen-path join on shingle sets.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or
more. In each run a set goes to the nodes of the shingles it samples: those whose hash, under the
run and the path so far, is below a rate over the size of the set, so that linked sets sample the
same shingles. Nodes of few sets are compared by brute force; larger ones split again on further
sampled shingles, up to a depth. Runs are repeated until a pair at the threshold is met with the
target probability. A large node is compared in blocks, without splitting it further, at full depth
or if most of its children keep a good part of its members: its sets are mutually similar, and
splitting would only repeat them.

Equal sets are one set with a number of copies. Nodes with the same members are compared once,
and a pair is counted at the first node it shares, so no pairs are emitted: a comparison yields
per set its number of links and one edge to the root of its part. Classes are the connected
components, found by passing on the smallest label.

Defined results: texts without words have no shingles and no links; a text of one to four words
has one shingle, all its words. Null texts count as empty. Null ids take part like others and
never name a class that has another id. Repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import drop_table, ship_package, write_table

from .columns import with_row_numbers
from .words import chunks, lower, mix, shingle_sets, word_hashes

WIDTH = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
LEAF_SETS = 64
BLOCK_SETS = 1024
DENSE_CHILD = 0.4
DENSE_SHARE = 0.5
RATES = (1.0, 2.0, 2.0)


def runs_needed(target: float = TARGET_RECALL, rates: tuple[float, ...] = RATES) -> int:
    """Runs after which a pair at the threshold has met with probability ``target``."""
    meet = 1.0
    for rate in reversed(rates):
        meet = 1 - math.exp(-rate * meet)
    return math.ceil(math.log(1 - target) / math.log(1 - meet))


def _cut(n: np.ndarray, rate: float) -> np.ndarray:
    """Hash limit under which a shingle of a set of ``n`` is sampled."""
    share = np.minimum(rate / (THRESHOLD * np.maximum(n, 1)), 1.0)
    return (share * (2.0 ** 32 - 1)).astype(np.uint64) << np.uint64(32) | np.uint64(0xFFFFFFFF)


def sampled(shingles: np.ndarray, node: np.uint64, limit) -> np.ndarray:
    """Children of a node for the shingles sampled there."""
    hashes = mix(shingles ^ node)
    return mix(shingles[hashes < limit] + mix(np.array([node + np.uint64(77)], dtype=np.uint64)))


def signature(flat: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """128-bit digest of each set, of its members in any order."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat), dtype=np.uint64)])[borders]
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])[borders]
    return np.stack([a[1:] - a[:-1], b[1:] - b[:-1]], axis=1)


def _sets_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, borders) of runs of texts."""
    for first, data, borders in chunks(lower(texts)):
        sets = shingle_sets(*word_hashes(data, borders), WIDTH)
        yield first, np.concatenate([*sets, np.empty(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _keys(signatures: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in signatures], pa.binary())


def _profile(runs: int):
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, borders in _sets_of(batch.column(1)):
                sizes = np.diff(borders)
                limits = np.repeat(_cut(sizes, RATES[0]), sizes)
                row = np.repeat(np.arange(len(sizes)), sizes)
                owners, nodes = [], []
                for seed in seeds:
                    taken = mix(flat ^ seed) < limits
                    owners.append(row[taken])
                    nodes.append(mix(flat[taken] + mix(np.array([seed + np.uint64(77)], dtype=np.uint64))))
                owner, node = np.concatenate(owners), np.concatenate(nodes)
                order = np.argsort(owner, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[order].view(np.int64)))
                part = batch.slice(first, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), _keys(signature(flat, borders)), pa.array(sizes, pa.int64()), lists],
                    ["id", "row", "digest", "key", "n", "nodes"])

    return profile


def _children(level: int):
    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, parents, sizes = [], [], [], []
            above = batch.column(2).to_pylist()
            for first, flat, borders in _sets_of(batch.column(1)):
                for k in range(len(borders) - 1):
                    own = flat[borders[k]:borders[k + 1]]
                    limit = _cut(np.array([len(own)]), RATES[level])[0]
                    key = batch.column(0)[first + k].as_py()
                    for parent in above[first + k]:
                        new = sampled(own, np.int64(parent["node"]).astype(np.uint64), limit)
                        keys += [key] * len(new)
                        parents += [parent["node"]] * len(new)
                        sizes += [parent["size"]] * len(new)
                        found.append(new)
            nodes = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(keys, pa.binary()), pa.array(parents, pa.int64()), pa.array(sizes, pa.int64())],
                ["node", "key", "parent", "parent_size"])

    return children


def _bit_rows(row: np.ndarray, column: np.ndarray, m: int) -> np.ndarray:
    """Packed bits of (row, column) pairs; columns are renumbered."""
    place = np.unique(column, return_inverse=True)[1] if len(column) else column
    bits = np.zeros((m, int(place.max()) // 64 + 1 if len(place) else 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits


def similar_pairs(sets: list[np.ndarray], split: int, seen: list[list[int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places of the sets linked with it): all pairs if ``split`` is 0, else those across it.

    Pairs with a common entry in ``seen`` are left out.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m <= 4:
        for i in range(m):
            found = []
            for j in range(i + 1, m):
                if (split and not i < split <= j) or min(sizes[i], sizes[j]) < THRESHOLD * max(sizes[i], sizes[j]) or set(seen[i]) & set(seen[j]):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= THRESHOLD * (sizes[i] + sizes[j] - both):
                    found.append(j)
            if found:
                yield i, np.array(found)
        return
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat)
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    bits = _bit_rows(row[several], column[several], m)
    met = _bit_rows(np.repeat(np.arange(m), [len(x) for x in seen]), np.array([x for own in seen for x in own], dtype=np.int64), m)
    for i in range(split or m):
        low = split or i + 1
        both = np.bitwise_count(bits[i] & bits[low:]).sum(axis=1, dtype=np.int64)
        linked = np.flatnonzero(both >= THRESHOLD * (sizes[i] + sizes[low:] - both))
        if len(linked):
            linked = linked[~(met[i] & met[low:][linked]).any(axis=1)]
            if len(linked):
                yield i, low + linked


def _compare_group(leaf: int, members: dict[bytes, tuple], blocks: tuple[int, int]) -> list[tuple]:
    """(key, links, root) of one comparison. ``members``: key to (block, copies, nodes, set)."""
    keys = sorted(members, key=lambda k: (members[k][0], k))
    split = sum(members[k][0] == blocks[0] for k in keys) if blocks[0] != blocks[1] else 0
    if blocks[0] != blocks[1] and not 0 < split < len(keys):
        return []
    root = list(range(len(keys)))
    links = np.zeros(len(keys), dtype=np.int64)
    copies = np.array([members[k][1] for k in keys])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # Pairs that share an earlier node are counted there.
    earlier = [[x for x in members[k][2] if x < leaf] for k in keys]
    for i, linked in similar_pairs([members[k][3] for k in keys], split, earlier):
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        for j in linked.tolist():
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return [(k, n, keys[find(i)]) for i, (k, n) in enumerate(zip(keys, links.tolist())) if n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, low, high): each run of equal ones is one comparison."""
    current, members, out = None, {}, []

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["key", "links", "root"])

    for batch in batches:
        leaf, low, high, block, key, copies, nodes = (batch.column(k).to_pylist() for k in range(7))
        for first, flat, borders in _sets_of(batch.column(7)):
            for k in range(len(borders) - 1):
                r = first + k
                group = (leaf[r], low[r], high[r])
                if group != current:
                    if members:
                        out += _compare_group(current[0], members, current[1:])
                    current, members = group, {}
                members[key[r]] = (block[r], copies[r], nodes[r], flat[borders[k]:borders[k + 1]].copy())
        yield emit()
    if members:
        out += _compare_group(current[0], members, current[1:])
    yield emit()


def _counted(rows: DataFrame) -> DataFrame:
    """(node, key, size) of the nodes with at least two keys, written."""
    several = write_table(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "nodes")
    found = write_table(rows.join(several, "node"), "members")
    drop_table(several)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(``key``, ``label``) of the connected components of (``key``, ``root``) edges."""
    both = edges.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b")
    both = write_table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b")).select("key", F.least("key", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["key"]).groupBy("b").agg(F.min("label").alias("near"))
        lower_labels = write_table(
            labels.join(near, labels["key"] == near["b"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        # The label of the label, so that long chains shorten by half each round.
        further = lower_labels.select(F.col("key").alias("at"), F.col("label").alias("beyond"))
        new = write_table(
            lower_labels.join(further, F.col("label") == F.col("at"), "left")
            .select("key", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        done = new.where("label <> old").isEmpty()
        drop_table(labels)
        drop_table(lower_labels)
        labels = new
        if done:
            drop_table(both)
            return labels.select("key", "label")


def near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: ``id``, ``digest`` (of the text), ``class_id`` (smallest id linked to it
    directly or through others) and ``n_links`` (other rows of similarity 0.8 or more)."""
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    base, row = with_row_numbers(df.select(quoted(id_column).cast("long").alias("id"), text.alias("text")), "id", stored=False)
    return _classes(base, row, "id", "text")[0].select("id", "digest", "class_id", "n_links")


def _classes(numbered: DataFrame, row: str, id_column: str, text_column: str) -> tuple[DataFrame, list[DataFrame]]:
    """What ``near_copies`` returns, with ``row`` and ``stays``: true for one row of each class.

    The tables written on the way come second; they can be dropped once the result is written.
    """
    made: list[DataFrame] = []

    def stored(df: DataFrame, purpose: str) -> DataFrame:
        made.append(write_table(df, purpose))
        return made[-1]

    ship_package(numbered.sparkSession)
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    base = numbered.select(quoted(id_column).cast("long").alias("id"), text.alias("text"), quoted(row).alias("row"))
    profiles = stored(
        base.select("id", "text", "row", F.xxhash64("text").alias("digest"))
        .mapInArrow(_profile(runs_needed()), "id long, row long, digest long, key binary, n long, nodes array<long>"), "profiles")
    # The first row is that with the smallest id, and of those the smallest number; null ids come last.
    sets = stored(profiles.where("n > 0").groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("copies"), F.first("nodes").alias("nodes")), "sets")

    members = _counted(sets.select("key", F.explode("nodes").alias("node")))
    made.append(members)
    active = members.select("key").distinct().join(sets.select("key", F.col("first.row").alias("row"), "copies"), "key")
    active = stored(active.join(base.select("row", "text"), "row").select("key", "text", "copies"), "active")
    leaves = members.where(F.col("size") <= LEAF_SETS).select("node", "key")
    big = members.where(F.col("size") > LEAF_SETS)
    for level in range(1, len(RATES)):
        grouped = big.groupBy("key").agg(F.collect_list(F.struct("node", "size")).alias("nodes"))
        children = grouped.join(active.select("key", "text"), "key").select("key", "text", "nodes")
        rows = stored(children.mapInArrow(_children(level), "node long, key binary, parent long, parent_size long").distinct(), "children")
        sizes = stored(rows.groupBy("node", "parent", "parent_size").agg(F.count("*").alias("size")), "nodes")
        kept = F.sum(F.when(F.col("size") >= DENSE_CHILD * F.col("parent_size"), F.col("size")))
        dense = sizes.groupBy("parent").agg((kept / F.sum("size")).alias("share")).where(F.col("share") >= DENSE_SHARE)
        dense = stored(dense.select(F.col("parent").alias("node")), "dense")
        leaves = leaves.unionByName(big.join(dense, "node", "left_semi").select("node", "key"))
        several = sizes.where("size > 1").join(dense.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "size")
        found = stored(rows.select("node", "key").join(stored(several, "nodes"), "node"), "members")
        last = level == len(RATES) - 1
        leaves = leaves.unionByName((found if last else found.where(F.col("size") <= LEAF_SETS)).select("node", "key"))
        big = found.where(F.col("size") > LEAF_SETS)

    # Of the nodes with the same members one is compared.
    named = leaves.groupBy("node").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"))
    chosen = stored(named.groupBy("size", "s", "x").agg(F.min("node").alias("node")).select("node", "size"), "chosen")
    leaves = stored(leaves.join(chosen, "node").select(F.col("node").alias("leaf"), "key", "size"), "leaves")
    mine = leaves.groupBy("key").agg(F.collect_list("leaf").alias("nodes"))
    rows = leaves.join(mine, "key").join(active, "key")
    count = F.ceil(F.col("size") / F.lit(float(BLOCK_SETS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), count))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    rows = rows.select(
        "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "copies", "nodes", "text")
    compared = stored(
        rows.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high").mapInArrow(_compare, "key binary, links long, root binary"), "links")

    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(compared.select("key", "root").distinct())
    made.append(labels)
    classes = sets.select("key", "first", "copies").join(links, "key", "left").join(labels, "key", "left")
    classes = stored(classes.select("key", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "key").alias("label")), "classes")
    heads = stored(classes.groupBy("label").agg(F.min("first").alias("head")), "heads")
    named_sets = stored(classes.join(heads, "label").select("key", "head", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "classes")
    out = profiles.select("id", "row", "digest", "key").join(named_sets, "key", "left")
    alone = F.col("n_links").isNull()
    return out.select(
        "id", "row", "digest", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("row") == F.col("head.row"))).alias("stays")), made


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", stored: bool = False) -> DataFrame:
    """``df`` with one row of each class, one with the smallest id.

    Of rows repeated with id and text one stays; a class without ids keeps one of its rows. Texts
    without words are in no class and all stay. A ``stored`` table, one whose every pass sees the same
    rows, is copied only if ids are null or repeated.
    """
    numbered, row = with_row_numbers(df, id_column, stored)
    found, made = _classes(numbered, row, id_column, text_column)
    gone = write_table(found.where(~F.col("stays")).select(F.col("row").alias(row)), "dropped")
    for part in made:
        drop_table(part)
    return numbered.join(gone, row, "left_anti").select(*(quoted(c) for c in df.columns))
