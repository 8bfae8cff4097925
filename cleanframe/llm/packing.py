"""Online packing of tokenised documents by the sum-of-squares rule.

Documents are tokenised and cut into whole windows and one remainder each. Remainders are placed
one after the other: a piece goes to the fill level that minimises the sum of the squared counts
of partially filled windows, kept in an array by level. Shards of a bounded number of pieces are
packed independently; windows still open at the end of a shard are packed again as pieces, in
further rounds of fewer shards.

Defined results: a null text counts as empty and yields the closing id alone. Repeated rows and
ids are packed like others. A text longer than a window is cut; nothing is dropped.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import ship_package, write_table

from .words import chunks, lower, prefix_sums, span_hash

WINDOW = 2048
PIECES_PER_SHARD = 20000
OPEN_PER_SHARD = 50000
CLOSING_ID = 1

# The split of word_bpe_49k.json, for texts of ASCII and the Latin letters U+00C0 to U+017F: runs
# of letters, single digits, and runs of anything else but white space. Any other text, one with a
# special token's opening, and one with an apostrophe before a letter go to the tokenizer whole.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[list(b" \t\n\r")] = _SPACE
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_ODD = np.zeros(256, dtype=bool)
_ODD[[x for x in range(32) if x not in b"\t\n\r"] + [127, 0xC2] + list(range(0xC6, 256))] = True
_ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0x3C, 0x7C))
_CACHE_WORDS = 400_000


class WordEncoder:
    """Token ids of texts; each distinct word is encoded once and then looked up by its hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.store = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        """Add words to the store; they are encoded together and told apart by closing tokens."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(
            [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)]
        flat = np.concatenate([np.array(x, dtype=np.uint32) for x in ids])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("words and closing tokens differ")
        n = len(self.place)
        used = int(self.ends[n])
        if used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.empty(max(len(flat), len(self.store)), dtype=np.uint32)])
        if n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(words), len(self.ends)), dtype=np.int64)])
        self.store[used:used + len(flat)] = flat
        self.ends[n + 1:n + 1 + len(words)] = used + ends
        self.place.update(zip(hashes, range(n, n + len(words))))

    def _plain(self, data: np.ndarray, borders: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the usual rows of a chunk of lower-cased text, and their borders by row."""
        kind = _CLASS[data]
        inside = kind != _SPACE
        apart = np.ones(len(data) + 1, dtype=bool)
        apart[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        apart[borders] = True
        starts = np.flatnonzero(inside & apart[:-1])
        ends = np.flatnonzero(inside & apart[1:]) + 1
        rows = np.searchsorted(starts, borders)
        skip = np.repeat(~usual, np.diff(rows))
        starts, ends = starts[~skip], ends[~skip]
        rows = np.concatenate([[0], np.cumsum(np.where(usual, np.diff(rows), 0))])
        hashes = span_hash(prefix_sums(data), starts, ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        change = np.ones(len(hashes), dtype=bool)
        change[1:] = hashes[1:] != hashes[:-1]
        first = order[change]
        if len(self.place) + len(first) > _CACHE_WORDS:
            self._forget()
        keys = hashes[change].tolist()
        new = [k for k, h in enumerate(keys) if h not in self.place]
        if new:
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self._learn([keys[k] for k in new], words)
        at = np.fromiter(map(self.place.__getitem__, keys), dtype=np.int64, count=len(keys))
        word = np.empty(len(order), dtype=np.int64)
        word[order] = np.repeat(at, np.diff(np.append(np.flatnonzero(change), len(order))))
        begin = self.ends[word]
        length = self.ends[word + 1] - begin
        sums = np.concatenate([[0], np.cumsum(length)])
        ids = self.store[np.repeat(begin - sums[:-1], length) + np.arange(sums[-1])]
        return ids, sums[rows]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; a null text is empty."""
        for row, data, borders in chunks(texts):
            odd = _ODD[data]
            for a, b in _ODD_PAIRS:
                odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
            odd[:-1] |= (data[:-1] == 0x27) & (_CLASS[data[1:]] == _LETTER)
            marks = np.concatenate([[0], np.cumsum(odd)])[borders]
            usual = marks[1:] == marks[:-1]
            n = len(borders) - 1
            part = texts.slice(row, n)
            # Lower case keeps the byte lengths of this repertoire; other rows are blanked for it.
            kept = pc.if_else(pa.array(usual), pc.fill_null(part, ""), "")
            (_, small, small_borders), = chunks(lower(kept), 1 << 62)
            ids, rows = self._plain(small, small_borders, usual)
            strange = np.flatnonzero(~usual).tolist()
            whole = self.tokenizer.encode_batch_fast([part[k].as_py() for k in strange], add_special_tokens=False)
            extra = {k: np.array(x.ids, dtype=np.uint32) for k, x in zip(strange, whole)}
            for k in range(n):
                yield extra[k] if k in extra else ids[rows[k]:rows[k + 1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document cut into windows and a remainder, with the checksum of each piece's ids."""
    ship_package(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1))):
                view = memoryview(np.append(ids, np.uint32(CLOSING_ID)).astype("<u4").tobytes())
                total = len(view) // 4
                for start in range(0, total, window):
                    piece = view[4 * start:4 * (start + window)]
                    for column, value in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder(tokenizer)._forget()  # workers are kept for other tasks; the words would stay with them

    chosen = df.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(cut, PIECE_SCHEMA)


def place(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and offset of each piece, in order of arrival, and the fill of each window."""
    level = np.zeros(window + 1, dtype=np.int64)
    standing: list[list[int]] = [[] for _ in range(window + 1)]
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    fills: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        # Change of the sum of squares: up one at the level reached, down one at the level left.
        # A level is filled exactly (last entry) or opened anew (first) without the other part.
        change = 2 * (level[size:window + 1] - level[:window - size + 1]) + 2
        change[level[:window - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * level[size] + 1
        if level[window - size]:
            change[-1] = 1 - 2 * level[window - size]
        h = window - size - int(np.argmin(change[::-1]))  # the fullest of equal levels
        if h:
            b = standing[h].pop()
            level[h] -= 1
        else:
            b = len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, h
        fills[b] = h + size
        if h + size < window:
            standing[h + size].append(b)
            level[h + size] += 1
    return bins, offsets, np.array(fills, dtype=np.int64)


def _round(items: DataFrame, per_shard: int, window: int, stage: int) -> DataFrame:
    """(``item``, ``bin``, ``at``, ``fill``) for (``item``, ``size``), shard by shard."""
    shards = max(1, -(-items.count() // per_shard))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "item"])
        bins, offsets, fills = place(group["size"].to_numpy(), window)
        shard = int(group["shard"].iloc[0])
        return pd.DataFrame({
            "item": group["item"].to_numpy(), "bin": (stage << 60) + (shard << 32) + bins,
            "at": offsets, "fill": fills[bins],
        })

    dealt = items.select("item", "size", F.xxhash64("item").alias("turn")).withColumn("shard", F.pmod("turn", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(pack, "item long, bin long, at long, fill long")


def pack(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every token of every row in one window."""
    cut = write_table(pieces(df, tokenizer, id_column, text_column, window).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == window).select("*", (F.lit(3 << 60) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < window)
    first = write_table(_round(rest.select("item", F.col("length").alias("size")), PIECES_PER_SHARD, window, 0), "packed")
    opened = first.where(F.col("fill") < window).select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
    second = write_table(_round(opened, OPEN_PER_SHARD, window, 1), "packed")
    moved = second.select(F.col("item").alias("bin"), F.col("bin").alias("into"), F.col("at").alias("shift"))
    placed = first.join(moved, "bin", "left").select(
        "item", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    return whole.unionByName(rest.join(placed, "item")).drop("item")
