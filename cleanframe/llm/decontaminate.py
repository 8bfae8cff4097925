"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of a window and ignore the others, so a window still hashes
alike after a substitution at an ignored place. Hashes of the documents are joined with those of
the benchmark, and around each hit item and document are compared word by word along the same
diagonal: an overlap is a run of at least ``LEAST_WORDS`` matching words that are ``LEAST_SHARE`` of
it. Every diagonal with such a run has an overlap; overlaps of one diagonal do not intersect.

The benchmark is a broadcast of bounded size: one above ``BLOCK_BYTES`` is split into blocks that
are compared one after the other in the same pass. Documents are never shuffled.

Defined results: null and empty texts, and items of fewer words than the shortest overlap, have
no overlaps. Repeated rows are compared like others; all columns of the table stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.schema import quoted
from cleanframe.session import ship_package

from .words import chunks, lower, mix, powers, word_hashes

# Fixed masks of weight six: places within a window that count.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 8, 9), (0, 2, 3, 6, 8, 11), (0, 1, 4, 7, 9, 10))
LEAST_WORDS = 12
LEAST_SHARE = 0.8
_SHARE = Fraction(str(LEAST_SHARE))
BLOCK_BYTES = 16_000_000
_FILTER_BITS = 22
OVERLAP = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
    T.StructField("end_word", T.LongType()), T.StructField("matched_words", T.LongType()),
]))


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the window at every place where the mask fits."""
    n = max(0, len(words) - mask[-1])
    sums = np.full(n, number + 1, dtype=np.uint64)
    for k, place in enumerate(mask):
        sums += words[place:place + n] * powers(len(mask) + 2)[0][k + 1]
    return mix(sums)


class SeedIndex:
    """Seed hashes of one block of benchmark items."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.items: list[np.ndarray] = []
        for _, data, borders in chunks(lower(pa.array(texts, pa.string()))):
            words, rows = word_hashes(data, borders)
            self.items += [words[a:b] for a, b in zip(rows[:-1], rows[1:])]
        self.keys, self.item, self.place = [], [], []
        for number, mask in enumerate(MASKS):
            found = [(seed_hashes(w, mask, number), k) for k, w in enumerate(self.items) if len(w) >= LEAST_WORDS]
            keys = np.concatenate([h for h, _ in found] or [np.empty(0, np.uint64)])
            item = np.concatenate([np.full(len(h), k) for h, k in found] or [np.empty(0, np.int64)]).astype(np.int64)
            place = np.concatenate([np.arange(len(h)) for h, _ in found] or [np.empty(0, np.int64)]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.item.append(item[order])
            self.place.append(place[order])

    def hits(self, words: np.ndarray) -> np.ndarray:
        """(place in ``words``, item, place in the item) of every seed hit."""
        out = []
        for number, mask in enumerate(MASKS):
            keys = self.keys[number]
            coarse = np.zeros(1 << _FILTER_BITS, dtype=bool)
            coarse[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            hashes = seed_hashes(words, mask, number)
            near = np.flatnonzero(coarse[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(keys, hashes[near], side="left")
            count = np.searchsorted(keys, hashes[near], side="right") - low
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append(np.stack([np.repeat(near, count), self.item[number][which], self.place[number][which]], axis=1))
        return np.concatenate(out)


def best_run(same: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the most agreeing words of all runs that count: (first, end, agreeing).

    A run counts if it has ``LEAST_WORDS`` agreeing words and they are ``LEAST_SHARE`` of it. It
    starts and ends with an agreeing word.
    """
    matched = np.concatenate([[0], np.cumsum(same)])
    # A run has the share if the sum at its end is not below that at its start.
    sums = matched * _SHARE.denominator - np.arange(len(matched)) * _SHARE.numerator
    # For each end the first start with the share; it has the most agreeing words.
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
    counts = matched - matched[starts]
    end = int(np.argmax(counts))
    if counts[end] < LEAST_WORDS:
        return None
    places = np.flatnonzero(same[starts[end]:end]) + starts[end]
    return int(places[0]), int(places[-1]) + 1, int(counts[end])


def diagonal_overlaps(document: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs of agreeing words on one diagonal: (first, end, agreeing) in the document's words.

    The best run, then those in what is left before and after it.
    """
    low, high = max(0, shift), min(len(document), shift + len(item))
    same = document[low:high] == item[low - shift:high - shift]
    found, parts = [], [(0, len(same))]
    while parts:
        a, b = parts.pop()
        run = best_run(same[a:b]) if b - a >= LEAST_WORDS else None
        if run:
            found.append((low + a + run[0], low + a + run[1], run[2]))
            parts += [(a, a + run[0]), (a + run[1], b)]
    return sorted(found)


def overlaps(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", into: str = "overlaps") -> DataFrame:
    """``df`` with an array of overlaps with benchmark items: item, word range, matched words.

    A column called as ``into`` is replaced.
    """
    df = df.drop(into)
    ship_package(df.sparkSession)
    items = benchmark.select(quoted(item_column).cast("long").alias("item"), quoted("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    place = df.columns.index(text_column)
    out = df.withColumn(into, F.array().cast(OVERLAP))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        index = SeedIndex([r[0] for r in rows], [r[1] for r in rows])
        out = out.mapInArrow(_comparer(index, place), out.schema)
    return out


def _comparer(index: SeedIndex, place: int):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("matched_words", pa.int64())]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[dict]] = {}
            for first, data, borders in chunks(lower(batch.column(place))):
                words, rows = word_hashes(data, borders)
                hits = index.hits(words)
                if not len(hits):
                    continue
                row = np.searchsorted(rows, hits[:, 0], side="right") - 1
                for r, item, shift in np.unique(np.stack([row, hits[:, 1], hits[:, 0] - rows[row] - hits[:, 2]], axis=1), axis=0).tolist():
                    for run in diagonal_overlaps(words[rows[r]:rows[r + 1]], index.items[item], shift):
                        found.setdefault(first + r, []).append(dict(zip(("item_id", "start_word", "end_word", "matched_words"), (index.ids[item], *run))))
            before = batch.column(batch.num_columns - 1).to_pylist() if batch.num_rows else []
            merged = pa.array([old + found.get(k, []) for k, old in enumerate(before)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], merged], names=batch.schema.names)

    return compare
