"""Alignment of two tokenisations of the same texts by divide and conquer at shared cuts.

Tokenizer A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` BPE model that puts a
space before a text; A reads the text with that space. Both sequences of tokens cover the same
bytes. A common end near the middle of a text is located by bisect, and both halves are cut on in
the same way; an interval without a common end inside is one group. All intervals of a depth
are cut at once, in arrays. An A token and a B token are linked where their bytes overlap.

Corpus counts of linked id pairs are a grouping. They come back to the documents in two ways, at
every size: pairs with more than one ``HOT_SHARE``-th of all links, of which there can be no more
than that number, are looked up in the tasks; all other pairs travel to their counts in a
join, where no pair has more than that share of the links.

Defined results: a null or empty text, and one whose tokens do not give back its bytes in A or in
B, has no tokens. Rows are aligned each by itself, repeated ones too, and all count for the
pairs. Null ids stay. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import ship_package, write_table

from .bytepair import byte_characters
from .segments import SegmentStore, spread, sums_from_zero, text_runs

HOT_SHARE = 1 << 19


# --- Tokens and their bytes ----------------------------------------------------------------

class TokenBytes:
    """Bytes of the tokens of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = sums_from_zero(self.sizes)[:-1]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[ids], self.sizes[ids])]


# Characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


class Tokenizers:
    """Both tokenizers; each distinct segment of a text is encoded once in a task.

    A segment is white space with what follows up to the next white space; white space that a piece of B
    has behind another character, as a carriage return, does not end it. A's pre-tokens have
    white space only at their beginning, so no merge of either crosses the borders of segments.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)
        if model["pre_tokenizer"]["type"] != "ByteLevel" or model["normalizer"]:
            raise ValueError("the first tokenizer must be byte-level without normalisation")
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = model["model"]["vocab"]
        tokens_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second tokenizer has a space behind another character")
        glued = "".join(c for c in WHITE_SPACE if any(c in p[1:] for p in pieces))
        tokens_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = TokenBytes(tokens_a), TokenBytes(tokens_b)
        space, rest, more = f"[{WHITE_SPACE}]", f"[^{WHITE_SPACE}]", f"[{glued}]" if glued else "(?!)"
        self.split = re.compile(f"{space}*{rest}+(?:{more}{space}*{rest}+)*(?:{more}{space}*)?|{space}+").findall
        self.store = SegmentStore(self._encode_a, self._encode_b, judge=self._given_back)
        self.lead = self.b.encode("a")

    def _encode_a(self, segments: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]

    def _encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids behind a letter, so that a segment of spaces alone is kept and none is added."""
        return [ids[len(self.lead):] for ids in self.b.encode(["a" + s for s in segments], num_threads=1)]

    def _given_back(self, segments: list[str], found: list[list[list[int]]]) -> np.ndarray:
        """Whether the tokens of both sides give back the bytes of each segment."""
        raw = [s.encode() for s in segments]
        good = np.ones(len(raw), dtype=bool)
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        for lists, table in zip(found, (self.bytes_a, self.bytes_b)):
            counts = np.array([len(x) for x in lists], dtype=np.int64)
            ids = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum()))
            ends = sums_from_zero(table.sizes[ids])[sums_from_zero(counts)]
            same = np.diff(ends) == sizes
            good &= same
            if same.all():
                differs = np.flatnonzero(table.joined(ids) != text)
                good[np.searchsorted(np.cumsum(sizes), differs, side="right")] = False
            else:  # lengths differ somewhere; segment by segment
                borders = sums_from_zero(counts)
                for k in np.flatnonzero(same).tolist():
                    good[k] &= table.joined(ids[borders[k]:borders[k + 1]]).tobytes() == raw[k]
        return good

    def both(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For A and B: ids of all texts and their borders by text; and which texts are given back by both."""
        spaced = [" " + t if t else "" for t in texts]
        parts = [self.split(t) for t in spaced]
        rows = sums_from_zero(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        places = self.store.places(list(itertools.chain.from_iterable(parts)))
        sides = []
        for side in range(2):
            ids, counts = self.store.ids_at(places, side)
            sides.append((ids, sums_from_zero(counts)[rows]))
        bad = np.diff(sums_from_zero(~self.store.marks[places])[rows])
        good = bad == 0
        for k in np.flatnonzero(bad).tolist():  # differing segments could still join to the same bytes
            good[k] = all(
                table.joined(ids[borders[k]:borders[k + 1]]).tobytes() == spaced[k].encode()
                for (ids, borders), table in zip(sides, (self.bytes_a, self.bytes_b)))
        return sides, good


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(*paths: str) -> Tokenizers:
    if paths not in _tokenizers:
        _tokenizers[paths] = Tokenizers(*paths)
    return _tokenizers[paths]


# --- Divide and conquer --------------------------------------------------------------------

def _seek(ends_a: np.ndarray, ends_b: np.ndarray, start: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
    """From each place ``start`` in A towards ``limit`` (not reached): the first end that B shares, or -1.

    Leaps from an end of one side to the next end of the other by bisect, until they agree.
    """
    found = np.full(len(start), -1, dtype=np.int64)
    live = np.flatnonzero(start < limit if forward else start > limit)
    at = start[live]
    while len(live):
        end = ends_a[at]
        if forward:
            other = ends_b[np.searchsorted(ends_b, end, side="left")]
        else:
            before = np.searchsorted(ends_b, end, side="right") - 1
            live, end, at, before = live[before >= 0], end[before >= 0], at[before >= 0], before[before >= 0]
            other = ends_b[before]
        same = other == end
        found[live[same]] = at[same]
        live, other = live[~same], other[~same]
        if forward:
            at = np.searchsorted(ends_a, other, side="left")
            inside = at < limit[live]
        else:
            at = np.searchsorted(ends_a, other, side="right") - 1
            inside = at > limit[live]
        live, at = live[inside], at[inside]
    return found


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, borders_a: np.ndarray, borders_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the tokens at which a group ends.

    ``ends_`` are the byte ends of the tokens of all texts, counted on from text to text;
    ``borders_`` are the token borders of the texts, which both end at the same byte.
    """
    full = borders_a[1:] > borders_a[:-1]
    low_a, high_a = borders_a[:-1][full], borders_a[1:][full] - 1  # first token, last token
    low_b, high_b = borders_b[:-1][full], borders_b[1:][full] - 1
    cuts_a, cuts_b = [high_a], [high_b]
    while True:
        open_ = (high_a > low_a) & (high_b > low_b)
        low_a, high_a, low_b, high_b = low_a[open_], high_a[open_], low_b[open_], high_b[open_]
        if not len(low_a):
            break
        # The last token's end is the interval's own; the ends before it may be cuts.
        middle = (low_a + high_a - 1) >> 1
        cut = _seek(ends_a, ends_b, middle, high_a, True)
        left = np.flatnonzero(cut < 0)
        cut[left] = _seek(ends_a, ends_b, middle[left] - 1, low_a[left] - 1, False)
        divided = cut >= 0
        low_a, high_a, low_b, high_b, cut = low_a[divided], high_a[divided], low_b[divided], high_b[divided], cut[divided]
        at_b = np.searchsorted(ends_b, ends_a[cut], side="left")
        cuts_a.append(cut)
        cuts_b.append(at_b)
        low_a, high_a = np.concatenate([low_a, cut + 1]), np.concatenate([cut, high_a])
        low_b, high_b = np.concatenate([low_b, at_b + 1]), np.concatenate([at_b, high_b])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


# --- Texts of the groups -------------------------------------------------------------------

def _decimals(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Right-aligned decimal digits of 0 to ``limit - 1``, one free column behind, and their numbers."""
    width = len(str(max(limit - 1, 0)))
    numbers = np.arange(limit)
    table = np.empty((limit, width + 1), dtype=np.uint8)
    for k in range(width):
        table[:, width - 1 - k] = numbers // 10 ** k % 10 + ord("0")
    return table, np.array([len(str(n)) for n in range(limit)], dtype=np.int64)


class GroupWriter:
    """``a1,a2|b1;a3|b2,b3`` of all texts of a run, as bytes and borders of the texts."""

    def __init__(self, limit: int):
        self.table, self.digits = _decimals(limit)

    def write(self, ids_a, ids_b, cuts_a, cuts_b, borders_a) -> tuple[np.ndarray, np.ndarray]:
        sizes_a, sizes_b = np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1)
        # A's tokens of a group stand behind all B tokens of the groups before, B's behind its A tokens.
        at_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)
        at_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
        n = len(ids_a) + len(ids_b)
        order, marks = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        order[at_a], order[at_b] = ids_a, ids_b
        marks[at_a[cuts_a]] = ord("|")
        marks[at_b[cuts_b]] = ord(";")
        lengths = self.digits[order] + 1
        last = np.searchsorted(cuts_a, borders_a[1:], side="left")  # groups up to the end of each text
        ends = sums_from_zero(sizes_a + sizes_b)[last]
        some = np.flatnonzero(np.diff(ends, prepend=0) > 0)
        cells = self.table[order]
        cells[:, -1] = marks
        width = cells.shape[1]
        kept = np.arange(width) >= width - lengths[:, None]
        kept[ends[some] - 1, -1] = False  # no mark behind the last group of a text
        lengths[ends[some] - 1] -= 1
        return cells[kept], sums_from_zero(lengths)[np.concatenate([[0], ends])]


@dataclass
class Aligned:
    """Alignment of a run of texts: arrays over tokens, groups and links, with borders by text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: np.ndarray
    groups_borders: np.ndarray
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


class Aligner:
    def __init__(self, *paths: str):
        self.tokenizers = tokenizers_of(*paths)
        self.size_b = len(self.tokenizers.bytes_b.sizes)
        self.writer = GroupWriter(max(len(self.tokenizers.bytes_a.sizes), self.size_b))

    def align(self, texts: list[str]) -> Aligned:
        found, good = self.tokenizers.both(texts)
        sides = []
        for (ids, borders), table in zip(found, (self.tokenizers.bytes_a, self.tokenizers.bytes_b)):
            counts = np.where(good, np.diff(borders), 0)
            kept = ids[spread(borders[:-1][good], np.diff(borders)[good])]
            sides.append((kept, sums_from_zero(counts), np.cumsum(table.sizes[kept])))
        (ids_a, borders_a, ends_a), (ids_b, borders_b, ends_b) = sides
        cuts_a, cuts_b = shared_cuts(ends_a, ends_b, borders_a, borders_b)
        groups, groups_borders = self.writer.write(ids_a, ids_b, cuts_a, cuts_b, borders_a)
        # Between two neighbours of all ends lie the bytes of one A token and one B token: a link.
        ends = np.concatenate([ends_a, ends_b])
        order = np.argsort(ends, kind="stable")  # merges two sorted runs
        first = np.diff(ends[order], prepend=0) > 0
        of_a = order < len(ends_a)
        at_a, at_b = (np.cumsum(of_a) - of_a)[first], (np.cumsum(~of_a) - ~of_a)[first]
        return Aligned(
            np.diff(borders_a), np.diff(borders_b), np.diff(np.searchsorted(cuts_a, borders_a, side="left")), groups, groups_borders,
            np.repeat(np.arange(len(texts)), np.diff(borders_a))[at_a], ids_a[at_a], ids_b[at_b],
        )


_aligners: dict[tuple[str, ...], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


# --- Spark ---------------------------------------------------------------------------------

ALIGNMENT_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<struct<a_id: int, b_id: int, links: int>>"
)


def alignments(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: numbers of tokens, groups and links, the groups as text, and the linked id pairs."""
    ship_package(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(path_a, path_b)
        for batch in batches:
            for row, texts in text_runs(batch.column(1)):
                yield _batch(batch.column(0).slice(row, len(texts)), found.align(texts), found.size_b)
        found.tokenizers.store.forget()

    chosen = df.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(work, ALIGNMENT_SCHEMA)


def _batch(ids: pa.Array, one: Aligned, size_b: int) -> pa.RecordBatch:
    n = len(ids)
    links = np.bincount(one.link_text, minlength=n)
    pair = one.link_a.astype(np.int64) * size_b + one.link_b
    order = np.argsort(one.link_text.astype(np.int64) << 40 | pair, kind="stable")
    text, pair = one.link_text[order], pair[order]
    first = np.ones(len(pair), dtype=bool)
    first[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(starts, append=len(pair))
    borders = np.searchsorted(text[starts], np.arange(n + 1), side="left")
    pairs = pa.StructArray.from_arrays(
        [pa.array((pair[starts] // size_b).astype(np.int32)), pa.array((pair[starts] % size_b).astype(np.int32)), pa.array(counts.astype(np.int32))],
        ["a_id", "b_id", "links"])
    groups = pa.LargeStringArray.from_buffers(n, pa.py_buffer(one.groups_borders.astype(np.int64).tobytes()), pa.py_buffer(one.groups.tobytes()))
    return pa.RecordBatch.from_arrays([
        ids, pa.array(one.n_a), pa.array(one.n_b), pa.array(one.n_groups), pa.array(links), groups.cast(pa.string()),
        pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pairs),
    ], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Corpus-wide links of each id pair: ``a_id``, ``b_id``, ``count``, ``best`` (the highest of its B id)."""
    found = aligned.select(F.inline("pairs")).groupBy("a_id", "b_id").agg(F.sum("links").alias("count"))
    found = write_table(found, "pairs")
    highest = found.groupBy("b_id").agg(F.max("count").alias("highest"))
    return found.join(highest, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, row: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """``aligned`` without ``pairs``, with ``n_best`` and ``count_sum`` over each row's links.

    ``row`` numbers the rows of ``aligned``. Both tables are read several times.
    """
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.col("count") > F.lit(total / hot_share)
    # At most hot_share pairs can have more than one hot_share-th of all links.
    known = counts.where(hot).select("a_id", "b_id", "count", "best").toArrow()
    keys = (known.column("a_id").to_numpy().astype(np.int64) << 32) | known.column("b_id").to_numpy()
    order = np.argsort(keys)
    keys, values, best = keys[order], known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
    kept = [c for c in aligned.columns if c != "pairs"]
    places = [aligned.columns.index(c) for c in aligned.columns if c != "pairs"]
    column = aligned.columns.index("pairs")
    schema = aligned.select(*kept, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), F.col("pairs").alias("cold")).schema
    cold_type = pa.list_(pa.struct([("a_id", pa.int32()), ("b_id", pa.int32()), ("links", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(column)
                borders = sums_from_zero(np.array(lists.value_lengths().to_pylist(), dtype=np.int64))
                pairs = lists.flatten()
                a, b, links = (pairs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                at = np.minimum(np.searchsorted(keys, a << 32 | b), max(len(keys) - 1, 0))
                here = keys[at] == (a << 32 | b) if len(keys) else np.zeros(len(a), dtype=bool)
                count = np.where(here, values[at], 0) if len(keys) else np.zeros(len(a), dtype=np.int64)
                top = here & best[at] if len(keys) else here
                sums = sums_from_zero(count * links)[borders]
                bests = sums_from_zero(np.where(top, links, 0))[borders]
                cold = pa.ListArray.from_arrays(pa.array(sums_from_zero(~here)[borders].astype(np.int32)), pairs.filter(pa.array(~here)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in places), pa.array(np.diff(bests)), pa.array(np.diff(sums)), cold.cast(cold_type)],
                    names=[*kept, "n_best", "count_sum", "cold"])

    looked = write_table(aligned.mapInArrow(work, schema), "looked_up")
    rest = looked.select(F.col(row).alias("_row"), F.inline("cold"))
    found = rest.join(counts.where(~hot), ["a_id", "b_id"]).groupBy("_row").agg(
        F.sum(F.col("links") * F.col("count")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
    joined = looked.join(found, looked[row] == found["_row"], "left")
    return joined.select(
        *kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
