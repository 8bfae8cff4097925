"""Toxic spans by a linear-chain conditional random field.

Tokens of labelled documents get labels by distant supervision: a word is toxic where it stands
in a toxic document and is, over the labelled sample, bound to toxic documents in many different
contexts. A two-state chain with hashed features (word, its beginnings and its end) is fitted by
gradient ascent on the conditional likelihood. Forward-backward marginals tag the spans; their
sums, through a small calibrated link, are the document's score.

A chain is a whole document, in the fit and in scoring. To walk all chains at once they are laid
out in blocks of ``BLOCK`` words: products of the step matrices of each block, joined by doubling
along the document, give every block what enters it from both sides, so no transition is lost
where a block ends and no document is too long.

The fit uses a bounded sample of the labelled rows: ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents,
one text of each id, of ``SAMPLE_BYTES`` together. All words of a sampled text enter the fit; every
row and whole text is scored. Only the text enters a score.

Defined results: null and empty texts get the score of a text without toxic words. Repeated rows
are scored alike; of texts repeated with one id the smallest hash enters the fit. Other columns stay. Without labels of both kinds the score is the share of
toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.schema import quoted
from cleanframe.session import drop_table, ship_package, write_table

from .words import chunks, mix, prefix_sums, span_hash, word_spans

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 18
BLOCK = 64
GROUP = 4000
LEAST_CONTEXTS = 8
PURITY = 0.02
ROUNDS = 50
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a chunk of texts: byte spans, rows, hashes, hashed features."""

    def __init__(self, data: np.ndarray, borders: np.ndarray):
        low = _LOWER[data]
        self.starts, self.ends, self.rows = word_spans(low, borders)
        sums = prefix_sums(low)
        self.hashes = span_hash(sums, self.starts, self.ends)
        pieces = [self.hashes]
        for kind, size in enumerate((4, 5, 6)):
            part = span_hash(sums, self.starts, np.minimum(self.starts + size, self.ends))
            pieces.append(mix(part + np.uint64(kind + 1)))
        pieces.append(mix(span_hash(sums, np.maximum(self.ends - 4, self.starts), self.ends) + np.uint64(9)))
        self.features = np.stack([(p % np.uint64(BUCKETS)).astype(np.int32) for p in pieces])


def joined(parts: list[Words]) -> Words:
    """The words of several chunks as one, without their byte spans."""
    out = Words.__new__(Words)
    out.hashes = np.concatenate([p.hashes for p in parts])
    out.features = np.concatenate([p.features for p in parts], axis=1)
    sizes = np.concatenate([np.diff(p.rows) for p in parts])
    out.rows = np.concatenate([[0], np.cumsum(sizes)])
    return out


class _Blocks:
    """A group of blocks: log odds of their words laid out by place and block, ready for a walk."""

    def __init__(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray, opens: np.ndarray):
        at = np.arange(BLOCK)[:, None]
        self.used = at < length
        self.index = np.where(self.used, first + at, 0)
        odds = np.where(self.used, scores[self.index], 0.0)
        self.top = np.maximum(odds, 0)
        self.e = np.stack([np.exp(-self.top), np.exp(odds - self.top)], axis=1)
        self.opens = opens

    def product(self, weights: np.ndarray) -> np.ndarray:
        """Product of the step matrices of each block (the last axis), up to a positive factor."""
        out = np.repeat(np.eye(2)[:, :, None], len(self.opens), axis=2)
        for t in range(BLOCK):
            step = out[:, 0, None] * weights[0, :, None] + out[:, 1, None] * weights[1, :, None]
            if not t:
                step[:, :, self.opens] = out[:, :, self.opens]
            step *= self.e[t]
            step /= step.max(axis=(0, 1))
            out = np.where(self.used[t], step, out)
        return out

    def walk(self, enter: np.ndarray, leave: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of the words, expected moves and log partition of these blocks."""
        e, n = self.e, len(self.opens)
        forward, scale, chance = np.empty_like(e), np.empty((BLOCK, n)), np.empty((BLOCK, n))
        for t in range(BLOCK):
            before = forward[t - 1] if t else enter
            f = (before[0] * weights[0, :, None] + before[1] * weights[1, :, None]) * e[t]
            if not t:
                f[:, self.opens] = e[0][:, self.opens]
            scale[t] = f[0] + f[1]
            forward[t] = f / scale[t]
        backward = leave
        moves = np.zeros((2, 2))
        for t in range(BLOCK - 1, -1, -1):
            live = self.used[t]
            both = forward[t] * backward
            chance[t] = both[1] / (both[0] + both[1])
            ahead = e[t] * backward
            pair = (forward[t - 1] if t else enter)[:, None] * weights[:, :, None] * ahead
            share = (live if t else ~self.opens) / pair.sum(axis=(0, 1))
            moves += pair @ share
            behind = weights[:, 0, None] * ahead[0] + weights[:, 1, None] * ahead[1]
            # Places after the end of a block hand on what comes from the next one.
            backward = np.where(live, behind / (behind[0] + behind[1]), backward)
        return chance, moves, float((np.log(scale) + self.top)[self.used].sum())


def _scan(products: np.ndarray, place: np.ndarray, backwards: bool) -> np.ndarray:
    """Product of each matrix with all before it (or after it) in its document, by doubling.

    ``place`` counts the matrices before (or after) one.
    """
    out, step = products.copy(), 1
    while len(place) and step <= place.max():
        at = np.flatnonzero(place >= step)
        left, right = (out[:, :, at], out[:, :, at + step]) if backwards else (out[:, :, at - step], out[:, :, at])
        joint = left[:, 0, None] * right[0] + left[:, 1, None] * right[1]
        out[:, :, at] = joint / joint.max(axis=(0, 1))
        step *= 2
    return out


def marginals(scores: np.ndarray, rows: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per word: probability of the toxic state; per pair: expected moves; and the log partition.

    ``scores`` is the log odds a word gives the toxic state, ``rows`` the word borders of the
    documents, each one chain, ``move`` the 2x2 log weights.
    """
    sizes = np.diff(rows)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    before = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    after = np.repeat(blocks, blocks) - 1 - before
    first = np.repeat(rows[:-1], blocks) + before * BLOCK
    length = np.minimum(BLOCK, np.repeat(rows[1:], blocks) - first)
    opens = before == 0
    weights = np.exp(move)

    def group(at: int) -> _Blocks:
        part = slice(at, at + GROUP)
        return _Blocks(scores, first[part], length[part], opens[part])

    enter, leave = np.full((2, total), 0.5), np.full((2, total), 0.5)
    if not opens.all():
        products = np.concatenate([group(at).product(weights) for at in range(0, total, GROUP)], axis=2)
        inner, goes_on = np.flatnonzero(before > 0), np.flatnonzero(after > 0)
        enter[:, inner] = _scan(products, before, False)[:, :, inner - 1].sum(axis=0)
        leave[:, goes_on] = _scan(products, after, True)[:, :, goes_on + 1].sum(axis=1)
        enter /= enter.sum(axis=0)
        leave /= leave.sum(axis=0)
    out, moves, log_partition = np.empty(len(scores)), np.zeros((2, 2)), 0.0
    for at in range(0, total, GROUP):
        part = group(at)
        chance, some, log = part.walk(enter[:, at:at + GROUP], leave[:, at:at + GROUP], weights)
        out[part.index[part.used]] = chance[part.used]
        moves += some
        log_partition += log
    return out, moves, log_partition


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float, move: np.ndarray, link: np.ndarray):
        self.weights, self.bias, self.move, self.link = weights, bias, move, link

    def tag(self, words: Words) -> np.ndarray:
        return marginals(self.weights[words.features].sum(axis=0) + self.bias, words.rows, self.move)[0]

    def document_features(self, chance: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Per row: constant, largest marginal, and the log of the sum of marginals over one half."""
        sums = np.concatenate([[0], np.cumsum(np.where(chance > 0.5, chance, 0))])[rows]
        n = np.diff(rows)
        most = np.zeros(len(n))
        filled = n > 0
        if filled.any():
            most[filled] = np.maximum.reduceat(chance, rows[:-1][filled])
        return np.stack([np.ones(len(n)), most, np.log1p(np.maximum(0, np.diff(sums)))])

    def score(self, chance: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.link @ self.document_features(chance, rows), -30, 30)))


def token_labels(words: Words, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic rows that are bound to toxic rows in many contexts."""
    row = np.repeat(np.arange(len(toxic)), np.diff(words.rows))
    before = np.empty_like(words.hashes)
    before[1:] = words.hashes[:-1]
    before[:1] = 0
    kinds, at = np.unique(words.hashes, return_inverse=True)
    # Copies of a document repeat its contexts, so contexts and not rows are counted.
    context = mix(before + mix(words.hashes)) ^ toxic[row].astype(np.uint64)
    first = np.unique(context, return_index=True)[1]
    bad = np.bincount(at[first], weights=toxic[row[first]], minlength=len(kinds))
    good = np.bincount(at[first], weights=~toxic[row[first]], minlength=len(kinds))
    bound = (bad >= LEAST_CONTEXTS) & (good <= PURITY * bad)
    return (bound[at] & toxic[row]).astype(np.int64)


def fit_chain(words: Words, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Emission weights, bias and moves that maximise the conditional likelihood of the labels."""
    weights, move, bias = np.zeros(BUCKETS), np.zeros((2, 2)), -2.0
    speed, move_speed, bias_speed = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    inner = np.ones(max(0, len(labels) - 1), dtype=bool)
    borders = words.rows[(words.rows > 0) & (words.rows < len(labels))]
    inner[borders - 1] = False
    seen = np.bincount(2 * labels[:-1][inner] + labels[1:][inner], minlength=4).reshape(2, 2)
    # Slopes are per toxic word, so that clean words in any number do not slow the rare ones.
    n = max(1, int(labels.sum()))
    for _ in range(rounds):
        scores = weights[words.features].sum(axis=0) + bias
        chance, moves, _ = marginals(scores, words.rows, move)
        error = (labels - chance) / n
        slope = sum(np.bincount(f, weights=error, minlength=BUCKETS) for f in words.features) - 1e-7 * weights
        speed += slope ** 2
        weights += 0.5 * slope / np.sqrt(speed)
        move_slope = (seen - moves) / n - 1e-4 * move
        move_speed += move_slope ** 2
        move += 0.2 * move_slope / np.sqrt(move_speed)
        bias_slope = error.sum()
        bias_speed += bias_slope ** 2
        bias += 0.2 * bias_slope / np.sqrt(bias_speed)
    return weights, float(bias), move


def fit_link(features: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Logistic link from document features to the label, by Newton steps with a small penalty.

    Rows are weighted to the share of toxic documents among all labelled ones.
    """
    mean = max(1e-9, toxic.mean())
    weight = np.where(toxic, share / mean, (1 - share) / max(1e-9, 1 - mean))
    link = np.zeros(len(features))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(link @ features, -30, 30)))
        slope = features @ (weight * (toxic - p)) - 0.1 * link
        curve = (features * (weight * p * (1 - p))) @ features.T + 0.1 * np.eye(len(link))
        link = link + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return link


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(quoted(id_column).cast("string").cast("binary")), F.lit(5)) == 0


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> ToxicityModel:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    ship_package(df.sparkSession)
    marks = labels.select(quoted(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    marks = marks.where(~held_out("id")).dropDuplicates(["id"])
    totals = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    total = max(1, sum(totals.values()))
    share = totals.get(1, 0) / total
    rank = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    limits = [int(1_000_003 * min(1.0, most / max(1, totals.get(k, 0)))) for k, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    picked = marks.where(rank < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0]))
    # Bounded by the sample sizes, up to the chance in the hash, and in bytes.
    texts = df.select(quoted(id_column).alias("id"), F.coalesce(quoted(text_column).cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(picked), "id").select("id", "toxic", F.struct(F.xxhash64("text").alias("order"), "text").alias("t"))
    one = one.groupBy("id", "toxic").agg(F.min("t").alias("t")).select("t.order", "t.text", "toxic")
    one = write_table(one, "labelled")
    left, large = SAMPLE_BYTES, []
    for order, size in one.select("order", F.octet_length("text")).orderBy("order").collect():
        if size <= left:
            left -= size
        else:
            large.append(order)
    sample = one.where(~F.col("order").isin(large)).select("text", "toxic").orderBy("order", "toxic").toArrow()
    drop_table(one)
    toxic = sample.column(1).to_numpy().astype(bool)
    none = ToxicityModel(np.zeros(BUCKETS), -20.0, np.zeros((2, 2)), np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0, 0]))
    if not toxic.any() or toxic.all():
        return none
    words = joined([Words(data, borders) for _, data, borders in chunks(sample.column(0))])
    labelled = token_labels(words, toxic)
    model = ToxicityModel(*fit_chain(words, labelled), none.link)
    model.link = fit_link(model.document_features(model.tag(words), words.rows), toxic, share)
    return model


def scored(df: DataFrame, model: ToxicityModel, text_column: str = "text", into: str = "toxicity", spans: str = "toxic_spans") -> DataFrame:
    """``df`` with the score and the character spans tagged toxic."""
    ship_package(df.sparkSession)
    place = df.columns.index(text_column)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType()), T.StructField(spans, SPAN)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, tagged = [np.empty(0)], [[] for _ in range(batch.num_rows)]
            for first, data, borders in chunks(batch.column(place)):
                words = Words(data, borders)
                chance = model.tag(words)
                scores.append(model.score(chance, words.rows))
                hit = np.flatnonzero(chance > 0.5)
                if len(hit):
                    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    row = np.searchsorted(words.rows, hit, side="right") - 1
                    base = characters[borders[row]]
                    for r, a, b in zip(row.tolist(), (characters[words.starts[hit]] - base).tolist(), (characters[words.ends[hit]] - base).tolist()):
                        tagged[first + r].append({"start": a, "end": b})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores)), pa.array(tagged, kind)], names=[*batch.schema.names, into, spans])

    return df.mapInArrow(apply, schema)
