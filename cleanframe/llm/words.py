"""Word and shingle hashes of whole texts, in numpy over the UTF-8 bytes of a batch.

A word is a run of letters, digits, underscores and non-ASCII characters of the lower-cased
text. Hashes are 64-bit and the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 500_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _IS_WORD[_c] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any byte span."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``, independent of where they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row borders) of runs of whole texts of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(lengths)])
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(borders, borders[row] + limit, side="right")) - 1)
        part = pa.concat_arrays([texts.slice(row, stop - row)])
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset:part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        yield row, data, offsets - offsets[0]
        row = stop


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def word_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the word borders of each row."""
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = borders[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and the word borders of each row."""
    starts, ends, rows = word_spans(data, borders)
    return span_hash(prefix_sums(data), starts, ends), rows


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row.

    A text of fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    n = len(hashes)
    sums = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        sums += hashes[k:k + len(sums)] * powers(width + 1)[0][k + 1]
    sums = mix(sums)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(sums[a:b - width + 1]))
        elif b > a:
            out.append(mix(np.sum(hashes[a:b] * powers(width + 1)[0][1:b - a + 1], keepdims=True)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def text_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Shingle set of each text, in order."""
    for _, data, borders in chunks(lower(texts)):
        yield from shingle_sets(*word_hashes(data, borders), width)
