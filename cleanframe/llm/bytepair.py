"""Byte-level BPE by a sentencepiece model that is serialised from the ranks of a vocabulary.

The model is written directly, field by field: one piece for each token, its bytes mapped to
printable characters, scored by its negative rank, with identity normalisation. Texts are split
by the vocabulary's pattern; each distinct pre-token is mapped to characters and encoded by the
model, whose merges then run in order of rank. Decoding maps ids to bytes.

Defined results: a null or empty text has no ids; a null array of ids decodes to no bytes. All
rows, repeated ones too, and all other columns stay; a column named as the new one is replaced.
Special tokens are not known, their strings are plain text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cleanframe.session import ship_package

from .segments import SegmentStore, spread, sums_from_zero, text_runs

# --- The model file ------------------------------------------------------------------------

# Field numbers and values of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_SCORE, _PIECE_TYPE = 1, 2, 3
_UNKNOWN_TYPE = 2
_MODEL_TYPE, _VOCABULARY_SIZE, _UNKNOWN_ID, _BEGIN_ID, _END_ID, _PAD_ID = 3, 4, 40, 41, 42, 43
_BPE = 2
_NAME, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5
_NO_ID = (1 << 64) - 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def byte_characters() -> list[str]:
    """Printable character of each byte: itself in three printable ranges, else from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of tokens: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the ranks; piece k has the k-th rank, the unknown piece is last."""
    characters = byte_characters()
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(characters[b] for b in token).encode()
        out.append(_block(_PIECES, _block(_PIECE_TEXT, piece) + _varint(_PIECE_SCORE << 3 | 5) + struct.pack("<f", -rank)))
    out.append(_block(_PIECES, _block(_PIECE_TEXT, b"<unk>") + _number(_PIECE_TYPE, _UNKNOWN_TYPE)))
    out.append(_block(_TRAINER, b"".join([
        _number(_MODEL_TYPE, _BPE), _number(_VOCABULARY_SIZE, len(ranks) + 1), _number(_UNKNOWN_ID, len(ranks)),
        _number(_BEGIN_ID, _NO_ID), _number(_END_ID, _NO_ID), _number(_PAD_ID, _NO_ID),
    ])))
    out.append(_block(_NORMALIZER, _block(_NAME, b"identity") + _number(_DUMMY_PREFIX, 0) + _number(_REMOVE_SPACES, 0) + _number(_ESCAPE_SPACES, 0)))
    return b"".join(out)


# --- Encoding and decoding -----------------------------------------------------------------

class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary must have every single byte")
        self.rank_of_piece = np.array(sorted(self.ranks.values()), dtype=np.int32)
        if len(np.unique(self.rank_of_piece)) != len(self.ranks) or self.rank_of_piece[-1] >= 1 << 24:
            raise ValueError("ranks must be distinct and below 2^24, where scores are exact")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.characters = dict(enumerate(byte_characters()))
        self.store = SegmentStore(self._encode)
        tokens = dict(zip(self.ranks.values(), self.ranks.keys()))
        sizes = np.zeros(int(self.rank_of_piece[-1]) + 1, dtype=np.int64)
        for rank, token in tokens.items():
            sizes[rank] = len(token)
        self.sizes, self.starts = sizes, sums_from_zero(sizes)[:-1]
        self.bytes = np.frombuffer(b"".join(tokens[r] for r in self.rank_of_piece.tolist()), dtype=np.uint8)

    def _encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of pre-tokens; one that is itself a token has its id, however its merges run."""
        raw = [s.encode() for s in segments]
        out = [[self.ranks[r]] if r in self.ranks else None for r in raw]
        rest = [k for k, ids in enumerate(out) if ids is None]
        mapped = [raw[k].decode("latin-1").translate(self.characters) for k in rest]
        for k, ids in zip(rest, self.model.encode(mapped, num_threads=1)):
            out[k] = self.rank_of_piece[ids].tolist()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their borders."""
        split = [self.split(t) for t in texts]
        ids, counts = self.store.ids_at(self.store.places([s for found in split for s in found]))
        borders = sums_from_zero(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        return ids, sums_from_zero(counts)[borders]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and the byte borders of the ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[spread(self.starts[ids], self.sizes[ids])], sums_from_zero(self.sizes[ids])


_coders: dict[tuple[str, str], BytePairs] = {}


def coder(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = BytePairs(path, pattern)
    return _coders[path, pattern]


def _with_column(df: DataFrame, source: str, into: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    """``df`` with ``into`` made from ``source`` by ``make``, which yields (rows, array) of runs of rows."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c != into]
    place, places = df.columns.index(source), [df.columns.index(c) for c in kept]
    schema = T.StructType([df.schema[k] for k in places] + [T.StructField(into, kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, made in make(batch.column(place)):
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in places), made.cast(arrow)], names=[*kept, into])

    return df.mapInArrow(work, schema)


def encoded(df: DataFrame, path: str, pattern: str, text_column: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the array ``into`` of the ids of each whole text."""

    def make(texts: pa.Array):
        pairs = coder(path, pattern)
        for row, run in text_runs(texts):
            ids, borders = pairs.encode(run)
            yield row, len(run), pa.LargeListArray.from_arrays(pa.array(borders), pa.array(ids))
        pairs.store.forget()

    return _with_column(df, text_column, into, T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32()), make)


def decoded(df: DataFrame, path: str, pattern: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes ``into`` of each array of ids."""

    def make(column: pa.Array):
        pairs = coder(path, pattern)
        for row in range(0, len(column), 256):
            part = column.slice(row, 256)
            counts = np.array([0 if n is None else n for n in part.value_lengths().to_pylist()], dtype=np.int64)
            raw, borders = pairs.decode(part.flatten().to_numpy(zero_copy_only=False))
            ends = borders[sums_from_zero(counts)]
            yield row, len(part), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])

    return _with_column(df, ids_column, into, T.BinaryType(), pa.binary(), make)
