"""Token ids of text segments, each distinct segment encoded once."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import CHUNK_BYTES

KEPT_CHARS = 16_000_000


def text_runs(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of whole texts of about ``limit`` bytes; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sums = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(sums, sums[row] + limit, side="right")) - 1)
        yield row, texts.slice(row, stop - row).to_pylist()
        row = stop


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``starts[k] + 0 .. lengths[k] - 1`` of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def sums_from_zero(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class _Places(dict):
    """Places of segments; one not yet seen gets the next place and is noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = place = len(self)
        self.new.append(segment)
        return place


class SegmentStore:
    """Ids of segments by one or more encoders, each of which takes a list of distinct segments.

    Segments are kept until they reach ``kept_chars`` characters, then all are forgotten, so the
    memory of a task stays bounded. ``judge`` marks new segments by their ids from each encoder.
    """

    def __init__(self, *encoders: Callable[[list[str]], list[list[int]]], judge=None, kept_chars: int = KEPT_CHARS):
        self.encoders, self.judge, self.kept_chars = encoders, judge, kept_chars
        self.forget()

    def forget(self) -> None:
        self.place = _Places()
        self.chars = 0
        self.ids = [np.empty(1 << 16, dtype=np.int32) for _ in self.encoders]
        self.ends = [np.zeros(1 << 16, dtype=np.int64) for _ in self.encoders]
        self.marks = np.empty(0, dtype=bool)

    def places(self, segments: list[str]) -> np.ndarray:
        """Place of each segment in the store; new ones are encoded together."""
        if self.chars > self.kept_chars:
            self.forget()
        known = len(self.place)
        out = np.fromiter(map(self.place.__getitem__, segments), dtype=np.int64, count=len(segments))
        new, self.place.new = self.place.new, []
        if new:
            self._learn(known, new)
        return out

    def _learn(self, known: int, new: list[str]) -> None:
        found = [encode(new) for encode in self.encoders]
        for side, lists in enumerate(found):
            ids, ends = self.ids[side], self.ends[side]
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            used, total = int(ends[known]), int(counts.sum())
            while used + total > len(ids):
                ids = np.concatenate([ids, np.empty_like(ids)])
            while known + len(new) + 1 > len(ends):
                ends = np.concatenate([ends, np.zeros_like(ends)])
            ids[used:used + total] = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=total)
            ends[known + 1:known + 1 + len(new)] = used + np.cumsum(counts)
            self.ids[side], self.ends[side] = ids, ends
        if self.judge:
            self.marks = np.concatenate([self.marks, self.judge(new, found)])
        self.chars += sum(map(len, new))

    def ids_at(self, places: np.ndarray, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments at these places, one after the other, and their numbers."""
        starts = self.ends[side][places]
        counts = self.ends[side][places + 1] - starts
        return self.ids[side][spread(starts, counts)], counts
