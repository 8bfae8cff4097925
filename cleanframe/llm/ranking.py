"""Ranked lexical search by a tree of documents with branch-and-bound.

Items are taken in groups of bounded text. One pass over the documents of a group counts the
words of every whole text and keeps its restricted term vector: the terms of the group's items
that it holds, with their occurrences. These vectors are written; document frequencies, the
number of documents and of words are aggregates over them.

A task then takes its vectors in runs. For each block of items a run becomes a tree: terms are in
order of falling document frequency, so documents with a common beginning share a path. A
subtree has the highest occurrences of each term and the smallest length factor of its
documents, which bound every score in it. The descent is depth first and keeps, on each path,
the items whose bound still reaches their fiftieth best score. Scores themselves are integers of 64 bits.

Every ``SEED_SHARE``-th vector is searched first, at every size; its fiftieth scores are true lower
bounds, so that the search over all vectors sends few candidates to the final ranking.

Defined results: null texts have no terms. Items with one id are one item with the terms of all
their texts; a null item id is such an id. Items without terms, and documents without any of an
item's terms, give no rows. Repeated documents are ranked each by itself; null document ids come
last among equal scores. Other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import ship_package, small_frame, write_table

from .segments import spread, sums_from_zero
from .words import chunks, prefix_sums, span_hash

BEST = 50
GROUP_BYTES = 4_000_000  # text of the items of one pass over the documents
BLOCK_ITEMS = 256  # items of one descent
BLOCK_TERMS = 8192
RUN_DOCUMENTS = 4096  # documents of one tree
RUN_ENTRIES = 200_000
LEAF_DOCUMENTS = 8
SEED_SHARE = 64
_PENDING = 100_000

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[128:] = True
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    _IS_TERM[ord(_low):ord(_high) + 1] = True
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[ord("A"):ord("Z") + 1] += 32


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


# --- Restricted term vectors ---------------------------------------------------------------

class Vocabulary:
    """Terms of a group of items, found in texts by hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.starts = sums_from_zero(self.sizes)[:-1]
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        hashes = span_hash(prefix_sums(self.flat), self.starts, self.starts + self.sizes)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (np.diff(self.hashes) == 0).any():
            raise ValueError("two terms have one hash")

    def vectors(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk of texts: words of each row; borders by row, terms and occurrences of the vectors."""
        data = _LOWER_BYTE[data]
        inside = _IS_TERM[data]
        apart = np.zeros(len(data) + 1, dtype=bool)
        apart[borders] = True
        before = np.concatenate([[False], inside])
        starts = np.flatnonzero(inside & (~before[:-1] | apart[:-1]))
        after = np.concatenate([inside[1:], [False]])
        ends = np.flatnonzero(inside & (~after | apart[1:])) + 1
        rows = np.searchsorted(starts, borders)
        words = np.diff(rows)
        if not len(self.hashes):
            return words, np.zeros(len(borders), dtype=np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = span_hash(prefix_sums(data), starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[hit]]
        length = ends[hit] - starts[hit]
        same = length == self.sizes[term]
        hit, term, length = hit[same], term[same], length[same]
        differs = data[spread(starts[hit], length)] != self.flat[spread(self.starts[term], length)]
        wrong = np.zeros(len(hit), dtype=bool)
        wrong[np.repeat(np.arange(len(hit)), length)[differs]] = True
        hit, term = hit[~wrong], term[~wrong]
        row = np.searchsorted(rows, hit, side="right") - 1
        keys, counts = np.unique(row.astype(np.int64) * len(self.hashes) + term, return_counts=True)
        return words, np.searchsorted(keys // len(self.hashes), np.arange(len(borders))), keys % len(self.hashes), counts


def term_vectors(docs: DataFrame, vocabulary: Vocabulary, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document; ``terms`` are numbers in the vocabulary."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, borders in chunks(batch.column(1)):
                words, ends, terms, counts = vocabulary.vectors(data, borders)
                offsets = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(words)), pa.array(words),
                    pa.ListArray.from_arrays(offsets, pa.array(terms.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                ], ["doc_id", "n", "terms", "tfs"])

    chosen = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<int>")


# --- The tree ------------------------------------------------------------------------------

def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of a term's weight, in millionths: rises with ``tf`` and falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Node:
    """Documents ``low`` to ``high - 1`` of a tree, which share their first ``depth`` terms."""

    low: int
    high: int
    depth: int


class DocumentTree:
    """Restricted vectors sorted by their terms; documents with a common beginning are neighbours.

    A node is a range of documents with the length of their common beginning. Children split the
    range where the next term differs.
    """

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, borders: np.ndarray, m: np.ndarray):
        raw = terms.astype(">u4").tobytes()
        order = sorted(range(len(m)), key=lambda k: raw[4 * borders[k]:4 * borders[k + 1]])
        self.order = np.array(order, dtype=np.int64)
        lengths = np.diff(borders)[self.order]
        places = spread(borders[:-1][self.order], lengths)
        self.terms, self.tfs, self.borders = terms[places], tfs[places], sums_from_zero(lengths)
        self.m = m[self.order]
        self.common = self._common(lengths)
        self.scratch = np.zeros(int(terms.max()) + 1 if len(terms) else 1, dtype=np.int64)

    def _common(self, lengths: np.ndarray) -> np.ndarray:
        """Number of terms each document shares at its beginning with the one before it."""
        out = np.zeros(len(lengths), dtype=np.int64)
        if len(lengths) > 1:
            both = np.minimum(lengths[1:], lengths[:-1])
            differs = self.terms[spread(self.borders[:-2], both)] != self.terms[spread(self.borders[1:-1], both)]
            ends = np.cumsum(both)
            marks = np.append(np.flatnonzero(differs), len(differs))
            out[1:] = np.minimum(marks[np.searchsorted(marks, ends - both)], ends) - (ends - both)
        return out

    def root(self) -> Node:
        return Node(0, len(self.m), 0)

    def children(self, node: Node) -> list[Node]:
        shared = self.common[node.low + 1:node.high]
        depth = int(shared.min())
        cuts = [node.low, *(np.flatnonzero(shared == depth) + node.low + 1).tolist(), node.high]
        return [Node(a, b, depth) for a, b in zip(cuts[:-1], cuts[1:])]

    def maxima(self, node: Node) -> tuple[np.ndarray, np.ndarray, int]:
        """Terms of the subtree, the highest occurrences of each, and the smallest length factor."""
        span = slice(int(self.borders[node.low]), int(self.borders[node.high]))
        np.maximum.at(self.scratch, self.terms[span], self.tfs[span])
        terms = np.flatnonzero(self.scratch)
        highest = self.scratch[terms]
        self.scratch[terms] = 0
        return terms, highest, int(self.m[node.low:node.high].min())


class Best:
    """The best documents of each item so far, and the score that another must reach."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()
        self.item, self.score, self.absent, self.doc = (np.empty(0, dtype=np.int64) for _ in range(4))
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, absent: np.ndarray, doc: np.ndarray) -> None:
        self.waiting.append((item, score, absent, doc))
        self.size += len(item)
        if self.size > _PENDING:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        item, score, absent, doc = (np.concatenate([x, *parts]) for x, parts in zip((self.item, self.score, self.absent, self.doc), zip(*self.waiting)))
        order = np.lexsort((doc, absent, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, rank = order[rank < BEST], item[rank < BEST], rank[rank < BEST]
        self.item, self.score, self.absent, self.doc = item, score[order], absent[order], doc[order]
        last = rank == BEST - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], self.score[last])
        self.waiting, self.size = [], 0


class Block:
    """Weights of the terms of a block of items, as a table of terms by items."""

    def __init__(self, first: int, items: list[np.ndarray], weights: np.ndarray):
        self.first = first
        self.terms = np.unique(np.concatenate(items))
        table = np.zeros((len(self.terms), len(items)), dtype=np.int64)
        for k, terms in enumerate(items):
            table[np.searchsorted(self.terms, terms), k] = weights[terms]
        self.table = table
        # Sums of weights by millionths: exact in doubles below 2^53, else integers are used.
        self.exact = int(table.sum(axis=0).max()) * 1_000_000 < 1 << 53
        self.fast = table.astype(np.float64) if self.exact else table

    def restrict(self, terms: np.ndarray, tfs: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        kept = self.terms[at] == terms
        return at[kept], tfs[kept], sums_from_zero(kept)[borders]

    def sums(self, terms: np.ndarray, shares: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Weighted sums for some of the items; ``shares`` is a row, or rows, over ``terms``."""
        part = self.fast[terms] if len(items) == self.fast.shape[1] else self.fast[np.ix_(terms, items)]
        return shares.astype(part.dtype) @ part

    def descend(self, tree: DocumentTree, absent: np.ndarray, docs: np.ndarray, best: Best) -> None:
        """Depth-first branch-and-bound: a subtree is entered with the items that it can still serve."""
        stack = [(tree.root(), np.arange(self.table.shape[1]))]
        while stack:
            node, items = stack.pop()
            terms, highest, m = tree.maxima(node)
            if not len(terms):
                continue
            bound = self.sums(terms, contribution(highest, m), items)
            items = items[(bound >= best.least[self.first + items]) & (bound > 0)]
            if not len(items):
                continue
            if node.high - node.low > LEAF_DOCUMENTS:
                children = tree.children(node)
                if len(children) > 1:
                    stack.extend((c, items) for c in reversed(children))
                    continue
            self._leaf(tree, node, terms, items, absent, docs, best)

    def _leaf(self, tree: DocumentTree, node: Node, terms: np.ndarray, items: np.ndarray, absent, docs, best: Best) -> None:
        span = slice(int(tree.borders[node.low]), int(tree.borders[node.high]))
        n = node.high - node.low
        row = np.repeat(np.arange(n), np.diff(tree.borders[node.low:node.high + 1]))
        shares = np.zeros((n, len(terms)), dtype=np.int64)
        shares[row, np.searchsorted(terms, tree.terms[span])] = contribution(tree.tfs[span], tree.m[node.low:node.high][row])
        scores = self.sums(terms, shares, items).astype(np.int64)
        doc, item = np.nonzero((scores > 0) & (scores >= best.least[self.first + items]))
        if len(doc):
            place = tree.order[node.low + doc]
            best.add(self.first + items[item], scores[doc, item], absent[place], docs[place])


@dataclass
class Group:
    """Items of one pass over the documents: ids, terms by number, and the terms' weights."""

    ids: list
    items: list[np.ndarray]
    rank: np.ndarray
    weights: np.ndarray

    def blocks(self) -> list[Block]:
        out, first, terms = [], 0, 0
        for k in range(len(self.items) + 1):
            full = k - first >= BLOCK_ITEMS or (k > first and k < len(self.items) and terms + len(self.items[k]) > BLOCK_TERMS)
            if k > first and (k == len(self.items) or full):
                out.append(Block(first, [self.rank[i] for i in self.items[first:k]], self.weights))
                first, terms = k, 0
            if k < len(self.items):
                terms += len(self.items[k])
        return out


def best_documents(vectors: DataFrame, group: Group, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): of each task's vectors (doc_id, m, terms, tfs) the best of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks = Best(least), group.blocks()
        for batch in batches:
            borders = sums_from_zero(np.array(batch.column(2).value_lengths().to_pylist(), dtype=np.int64))
            terms = group.rank[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(borders))
            order = np.lexsort((terms, row))
            terms, tfs = terms[order], tfs[order]
            m = batch.column(1).to_numpy(zero_copy_only=False)
            absent = np.array(batch.column(0).is_null().to_pylist(), dtype=np.int64)
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                stop = min(start + RUN_DOCUMENTS, max(start + 1, int(np.searchsorted(borders, borders[start] + RUN_ENTRIES, side="right")) - 1), batch.num_rows)
                span = slice(int(borders[start]), int(borders[stop]))
                for block in blocks:
                    own, counts, ends = block.restrict(terms[span], tfs[span], borders[start:stop + 1] - borders[start])
                    if len(own):
                        block.descend(DocumentTree(own, counts, ends, m[start:stop]), absent[start:stop], docs[start:stop], best)
                best.settle()
                start = stop
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.absent.astype(bool)), pa.array(best.score)], ["item", "doc_id", "score"])

    return vectors.select("doc_id", "m", "terms", "tfs").mapInArrow(work, "item int, doc_id long, score long")


def ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best ``BEST`` documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    asked = items.select(quoted(item_column).cast("long").alias("item_id"), quoted(item_text).cast("string").alias("text"))
    asked = write_table(asked.where("text is not null"), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = 1 + size // GROUP_BYTES
    out = small_frame(spark, [], pa.schema([("item_id", pa.int64()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))
    for k in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k).collect()
        terms: dict = {}
        for item, text in rows:
            terms.setdefault(item, set()).update(terms_of(text))
        out = out.unionByName(_search_group(docs, {i: t for i, t in terms.items() if t}, id_column, text_column))
    return out


def _search_group(docs: DataFrame, items: dict, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    words = sorted(set().union(*items.values()))
    vectors = write_table(term_vectors(docs, Vocabulary(words), id_column, text_column), "vectors")
    n, total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), dtype=np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    number = {w: k for k, w in enumerate(words)}
    order = np.argsort(-df, kind="stable")  # the most frequent first
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df[order].tolist()], dtype=np.int64)
    ids = list(items)
    group = Group(ids, [np.sort(np.array([number[w] for w in items[i]], dtype=np.int64)) for i in ids], rank, weights)
    least = np.ones(len(ids), dtype=np.int64)
    useful = vectors.where(F.size("terms") > 0).withColumn("m", F.expr(f"50 + (50 * n * {n}L) div {max(total, 1)}L"))
    seeds = ranked(best_documents(useful.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SEED_SHARE)) == 0), group, least))
    for item, score in seeds.where(F.col("rank") == BEST).select("item", "score").collect():
        least[item] = max(least[item], score)
    names = small_frame(spark, [{"item": k, "item_id": i} for k, i in enumerate(ids)], pa.schema([("item", pa.int32()), ("item_id", pa.int64())]))
    return ranked(best_documents(useful, group, least)).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
