"""Quality classifier from a weak-label model.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the counts of their vote patterns, taken from all documents, estimates how often each labeller is
right for good and for bad documents; the posterior of a pattern is a soft label. The soft labels
of a bounded sample train a hashed linear scorer over the shapes of words, which scores all.

Defined results: a null text counts as empty; an empty text is bad. All columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.schema import quoted
from cleanframe.session import ship_package

from .words import chunks, mix, prefix_sums, span_hash

SAMPLE_ROWS = 4_000
BUCKETS = 1 << 16
LABELLERS = 6
ABSTAIN, BAD, GOOD = 0, 1, 2

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:?'\"-()")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _per_row(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[borders])


class Tokens:
    """White-space tokens of a chunk of texts: borders by row, raw hashes, hashed features."""

    def __init__(self, data: np.ndarray, borders: np.ndarray):
        inside = ~_SPACE[data]
        apart = np.zeros(len(data) + 1, dtype=bool)
        apart[1:-1] = inside[1:] != inside[:-1]
        apart[borders] = True
        starts = np.flatnonzero(inside & apart[:-1])
        ends = np.flatnonzero(inside & apart[1:]) + 1
        self.rows = np.searchsorted(starts, borders)
        self.raw = span_hash(prefix_sums(data), starts, ends)
        upper = data.copy()
        shape = _SHAPE[upper]
        accents = np.zeros(len(data), dtype=bool)
        accents[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        shape[accents] = ord("A")
        lead = np.flatnonzero(accents) - 1
        shape[lead] = ord("A")
        self.upper = _UPPER[data] | accents
        keep = np.ones(len(data), dtype=bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        self.shape = span_hash(prefix_sums(shape[keep]), at[starts], at[ends])
        self.again = np.zeros(len(starts), dtype=bool)
        self.again[1:] = self.raw[1:] == self.raw[:-1]
        first = self.rows[:-1][self.rows[:-1] < len(starts)]
        self.again[first] = False
        single = self.shape + self.again.astype(np.uint64)
        pair = single.copy()
        pair[1:] += single[:-1] * np.uint64(0x9E3779B97F4A7C15)
        pair[first] = single[first] * np.uint64(3)
        size = np.uint64(BUCKETS)
        self.buckets = np.stack([mix(single) % size, mix(pair) % size]).astype(np.int64)


def votes(data: np.ndarray, borders: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Vote of each labeller on each row: nothing, bad or good."""
    n = np.diff(tokens.rows)
    words = np.maximum(n, 1)
    letters = np.maximum(_per_row(_LETTER[data], borders), 1)
    visible = np.maximum(_per_row(~_SPACE[data], borders), 1)
    marks = _per_row(~(_LETTER | _SPACE | _STOP | _DIGIT)[data], borders)
    upper = _per_row(tokens.upper, borders) / letters
    again = _per_row(tokens.again, tokens.rows) / words
    stops = _per_row(data == ord("."), borders) / words
    kinds = np.array([len(np.unique(tokens.raw[a:b])) for a, b in zip(tokens.rows[:-1], tokens.rows[1:])]) / words
    out = np.zeros((len(n), LABELLERS), dtype=np.int64)

    def vote(k: int, bad: np.ndarray, good: np.ndarray) -> None:
        out[:, k] = np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    vote(0, upper > 0.3, (upper < 0.15) & (n > 0))
    vote(1, marks / words > 0.25, (marks / words < 0.05) & (n > 0))
    vote(2, (marks + 0.0) / visible > 0.08, marks / visible < 0.02)
    vote(3, again > 0.3, (again < 0.05) & (n > 0))
    vote(4, (kinds < 0.2) & (n > 40), (kinds > 0.4) & (n > 0))
    vote(5, n == 0, (stops > 0.02) & (stops < 0.3))
    return out


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents and vote probabilities ``[class, labeller, vote]`` by EM.

    Starts from: a pattern with any bad vote is probably bad.
    """
    good = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    share, table = 0.5, np.empty((2, LABELLERS, 3))
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            for k in range(LABELLERS):
                table[c, k] = np.bincount(patterns[:, k], weights=weight, minlength=3) + 0.5
                table[c, k] /= table[c, k].sum()
        share = float((counts * good).sum() / max(1.0, counts.sum()))
        good = posterior(patterns, share, table)
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    columns = np.arange(LABELLERS)
    logs = np.log(table[:, columns, patterns]).sum(axis=-1)
    odds = logs[1] - logs[0] + np.log((share + 1e-9) / (1 - share + 1e-9))
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_scorer(buckets: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of the linear scorer (the bias last), by gradient descent on soft labels.

    ``buckets`` and ``counts`` hold the distinct features of each text and how often each occurs.
    """
    lengths = np.array([max(1, c.sum()) for c in counts])
    flat = np.concatenate([*buckets, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    share = np.concatenate([*counts, np.empty(0, np.int64)]) / lengths[row]
    weights = np.zeros(BUCKETS + 1)
    speed = np.full(BUCKETS + 1, 1e-8)
    balance = np.where(labels > 0.5, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    for _ in range(rounds):
        score = np.bincount(row, weights[flat] * share, minlength=len(buckets)) + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - labels) / max(1, len(buckets))
        slope = np.append(np.bincount(flat, error[row] * share, minlength=BUCKETS), error.sum()) + 1e-6 * weights
        speed += slope ** 2
        weights -= 0.5 * slope / np.sqrt(speed)
    return weights


class QualityModel:
    def __init__(self, share: float, table: np.ndarray, weights: np.ndarray):
        self.share, self.table, self.weights = share, table, weights

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scorer's probability of good, and the posterior of the votes."""
        scores, beliefs = [np.empty(0)], [np.empty(0)]
        for _, data, borders in chunks(texts):
            tokens = Tokens(data, borders)
            sums = np.concatenate([[0], np.cumsum(self.weights[tokens.buckets[0]] + self.weights[tokens.buckets[1]])])[tokens.rows]
            n = np.diff(tokens.rows)
            raw = np.diff(sums) / np.maximum(1, 2 * n) + self.weights[-1]
            scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0))
            beliefs.append(posterior(votes(data, borders, tokens), self.share, self.table))
        return np.concatenate(scores), np.concatenate(beliefs)


def fit(df: DataFrame, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Accuracies from the votes on all rows; scorer from about ``sample_rows`` of them.

    The sample holds each text whole, as counts of at most ``BUCKETS`` features.
    """
    ship_package(df.sparkSession)
    texts = df.select(quoted(text_column).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 ** LABELLERS, dtype=np.int64)
        for batch in batches:
            for _, data, borders in chunks(batch.column(0)):
                code = votes(data, borders, Tokens(data, borders)) @ 3 ** np.arange(LABELLERS)
                sums += np.bincount(code, minlength=len(sums))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], ["pattern", "n"])

    # At most 3^LABELLERS patterns, whatever the table holds.
    found = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes, counts = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float)
    patterns = codes[:, None] // 3 ** np.arange(LABELLERS) % 3
    share, table = fit_accuracies(patterns, counts)
    total = max(1, int(counts.sum()))
    share_taken = min(1.0, sample_rows / total)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, repeats, codes = [], [], []
            for _, data, borders in chunks(batch.column(1)):
                tokens = Tokens(data, borders)
                codes += (votes(data, borders, tokens) @ 3 ** np.arange(LABELLERS)).tolist()
                for a, b in zip(tokens.rows[:-1], tokens.rows[1:]):
                    seen, often = np.unique(tokens.buckets[:, a:b].ravel().astype(np.int32), return_counts=True)
                    rows.append(seen)
                    repeats.append(often.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (rows, repeats)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64()), *lists], ["key", "pattern", "buckets", "counts"])

    # Each text once: all copies of a text are picked together, and may be a third of all rows.
    picked = texts.select(F.xxhash64("text").alias("key"), "text").where(F.pmod("key", F.lit(1_000_003)) < int(1_000_003 * share_taken) + 1)
    picked = picked.groupBy("key").agg(F.min("text").alias("text"))
    sample = picked.mapInArrow(features, "key long, pattern long, buckets array<int>, counts array<int>").toArrow().sort_by("key").drop_columns("key")
    codes = sample.column(0).to_numpy()
    buckets, counts = ([x.values.to_numpy() for x in sample.column(k)] for k in (1, 2))
    soft = posterior(codes[:, None] // 3 ** np.arange(LABELLERS) % 3, share, table)
    return QualityModel(share, table, fit_scorer(buckets, counts, soft) if len(buckets) else np.zeros(BUCKETS + 1))


def scored(df: DataFrame, model: QualityModel, text_column: str = "text", into: str = "quality_score", belief: str = "weak_label") -> DataFrame:
    """``df`` with the scorer's probability of good and the posterior of the votes.

    Columns that are called as one of the two are replaced.
    """
    ship_package(df.sparkSession)
    place = df.columns.index(text_column)
    kept = [k for k, c in enumerate(df.columns) if c not in (into, belief)]
    fields = [df.schema.fields[k] for k in kept]
    schema = T.StructType([*fields, T.StructField(into, T.DoubleType()), T.StructField(belief, T.DoubleType())])
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, weak = model.score(batch.column(place))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(score), pa.array(weak)], names=names)

    return df.mapInArrow(apply, schema)
