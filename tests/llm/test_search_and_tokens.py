"""Ranked search, alignment of tokenisations and byte pairs, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from cleanframe.llm import alignment, bytepair, ranking
from cleanframe.llm.queries import all_queries, split_pattern, tokenizer_path
from cleanframe.session import write_table

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a ", "\n\n  x", "<|endoftext|> <s> </s> <0x41>", "日本語 🎉👨‍👩‍👧 ñ́", "a" * 3000, "\x00\x01\xa0", "漢" * 1000,
    "🎉" * 300, " " * 300, "▁▁ x", "x▁ y", "  lead", "trail  ", "One, two; ONE_two 3.14 Ünder", "one two", "one two", "It's we'll  they've",
    "x;\r\n y();\r\r z\r", "\r", "a\r\n", "{\r {\r\n",
    *(f"ab{c}cd! {c}{c}x{c} {c}12 .{c}" for c in alignment.WHITE_SPACE + "\x1c\x1f\u180e\u200b\u2060\ufeff"),
]
SCHEMA = "doc_id long, text string, ids string, item int, rank int, m int, row int, groups int, pairs int, n int, terms int"


@pytest.fixture(scope="module")
def odd(spark):
    chance = random.Random(7)
    pools = [(32, 127), (0x20, 0x2000), (0x10000, 0x1FFFF)]
    texts = ODD + ["".join(chr(chance.choice([32, chance.randrange(*chance.choice(pools))])) for _ in range(80)) for _ in range(60)]
    data = [(None if k == 3 else k // 2, t, "i", 1, 1, 1, 1, 1, 1, 1, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- Byte pairs --------------------------------------------------------------------------

def vocabulary():
    return tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern()


def test_ids_are_those_of_the_reference_encoder(odd, documents):
    path, pattern = vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytepair.read_ranks(path), special_tokens={})
    for df in (odd, documents):
        out = bytepair.decoded(bytepair.encoded(df, path, pattern, into="found"), path, pattern, "found")
        assert out.columns == [*df.columns, "found", "decoded"]
        rows = out.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
        for r in rows:
            assert r.found == other.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")


def test_every_token_merges_to_itself():
    pairs = bytepair.coder(*vocabulary())
    for token, rank in pairs.ranks.items():
        assert pairs.model.encode(token.decode("latin-1").translate(pairs.characters)) == [rank]


def test_ranks_with_gaps_keep_their_numbers(tmp_path):
    import base64

    tokens = {bytes([b]): 10 + b for b in range(256)} | {b"ab": 1000, b"abc": 5000, b"xyz": 9000}
    path = tmp_path / "own.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in tokens.items()))
    pairs = bytepair.BytePairs(str(path), split_pattern())
    ids, borders = pairs.encode(["abcab xyz", "xyz"])
    # A pre-token that is a token has its id although no merge leads to it.
    assert ids.tolist() == [5000, 1000, 42, 10 + ord("x"), 10 + ord("y"), 10 + ord("z"), 9000] and borders.tolist() == [0, 6, 7]
    assert pairs.decode(ids)[0].tobytes() == b"abcab xyzxyz"
    with pytest.raises(ValueError):
        pairs.decode(np.array([999]))


def test_a_replaced_column_and_null_ids(spark, odd):
    path, pattern = vocabulary()
    out = bytepair.encoded(odd, path, pattern)
    assert sorted(out.columns) == sorted(odd.columns) and out.schema["ids"].dataType.simpleString() == "array<int>"
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bytepair.decoded(null, path, pattern).collect()] == [b"", b""]
    assert bytepair.encoded(odd.limit(0), path, pattern).count() == 0


def test_byte_pair_query(spark, documents):
    path, pattern = vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytepair.read_ranks(path), special_tokens={})
    expected = set()
    for r in documents.collect():
        ids = other.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), r.text or ""))))
    got = all_queries()["op13_byte_pairs"](spark, SMALL)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == expected


# --- Alignment ---------------------------------------------------------------------------

def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_alignment(text):
    """(number of A tokens, of B tokens, groups as text, links) token by token."""
    both = alignment.tokenizers_of(*paths())
    a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids
    b = both.b.encode(text or "")
    raw = (" " + (text or "")).encode()
    if not text or both.bytes_a.joined(np.array(a)).tobytes() != raw or both.bytes_b.joined(np.array(b)).tobytes() != raw:
        return 0, 0, "", []
    ends_a, ends_b = (np.cumsum(t.sizes[ids]).tolist() for ids, t in ((a, both.bytes_a), (b, both.bytes_b)))
    groups, links, i, j, start_a, start_b = [], [], 0, 0, 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append(",".join(map(str, a[start_a:i])) + "|" + ",".join(map(str, b[start_b:j])))
            start_a, start_b = i, j
    return len(a), len(b), ";".join(groups), links


def digests(rows):
    """Expected rows of the query for (doc_id, text)."""
    found = [(i, *plain_alignment(t)) for i, t in rows]
    counts = Counter(link for *_, links in found for link in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return Counter((
        i, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
        hashlib.sha256(groups.encode()).hexdigest() if groups else "",
    ) for i, n_a, n_b, groups, links in found)


@pytest.mark.parametrize("hot_share", [1, 500, 1 << 19])
def test_alignments_of_odd_texts(odd, hot_share):
    found = write_table(alignment.alignments(odd, *paths()).withColumn("row", F.monotonically_increasing_id()), "aligned")
    out = alignment.link_sums(found, write_table(alignment.pair_counts(found), "counts"), "row", hot_share).collect()
    got = Counter((
        r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "",
    ) for r in out)
    assert got == digests([(r.doc_id, r.text) for r in odd.collect()])


def test_alignment_query(spark, documents):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = Counter(tuple(r[c] for c in names) for r in all_queries()["op12_alignment"](spark, SMALL).collect())
    assert got == digests([(r.doc_id, r.text) for r in documents.collect()])


def test_cuts_of_long_intervals_without_a_common_end():
    a, b = np.arange(2, 4001, 2), np.append(np.arange(1, 4000, 2), 4000)
    cuts = alignment.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert [c.tolist() for c in cuts] == [[len(a) - 1], [len(b) - 1]]
    chance = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(np.append(chance.integers(1, 400, chance.integers(0, 120)), 400)) for _ in range(2))
        cuts = alignment.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        assert a[cuts[0]].tolist() == b[cuts[1]].tolist() == np.intersect1d(a, b).tolist()


def test_alignment_of_an_empty_table(odd):
    found = write_table(alignment.alignments(odd.limit(0), *paths()).withColumn("row", F.monotonically_increasing_id()), "aligned")
    assert alignment.link_sums(found, write_table(alignment.pair_counts(found), "counts"), "row").count() == 0


# --- Ranked search -----------------------------------------------------------------------

def plain_ranking(docs, items, best):
    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(x for _, w in words for x in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(ranking.terms_of(t))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for doc, w in words:
            tf, m = Counter(w), 50 + 50 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:best], 1):
            out[item, rank, doc, -score] += 1
    return out


ITEMS = [(1, "one two three"), (2, None), (3, ""), (4, "..., !"), (None, "trail lead x"), (5, "One Two"), (5, "日本語 ünder"), (6, "nowhere_found"), (1, "one two three")]


@pytest.mark.parametrize("small", [False, True])
def test_ranking_of_odd_texts(spark, odd, monkeypatch, small):
    if small:  # several groups, blocks, trees and settlements
        for name, value in (("GROUP_BYTES", 20), ("BLOCK_ITEMS", 1), ("RUN_DOCUMENTS", 7), ("LEAF_DOCUMENTS", 1), ("_PENDING", 3), ("SEED_SHARE", 2)):
            monkeypatch.setattr(ranking, name, value)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, item int, rank int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.search(odd, items).collect())
    assert got == plain_ranking([(r.doc_id, r.text) for r in odd.collect()], ITEMS, ranking.BEST)
    assert ranking.search(odd.limit(0), items).count() == 0 and ranking.search(odd, items.limit(0)).count() == 0


def test_maxima_and_minima_of_every_subtree(documents, spark):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    terms = sorted({t for _, x in asked for t in ranking.terms_of(x)})
    number = {t: k for k, t in enumerate(terms)}
    counts = [Counter(number[w] for w in ranking.terms_of(t) if w in number) for _, t in docs]
    borders = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    flat = [(t, n) for c in counts for t, n in sorted(c.items())]
    m = np.array([50 + len(t or "") // 20 for _, t in docs], dtype=np.int64)
    tree = ranking.DocumentTree(np.array([t for t, _ in flat]), np.array([n for _, n in flat]), borders, m)
    nodes = [tree.root()]
    while nodes:
        node = nodes.pop()
        found, highest, least = tree.maxima(node)
        inside = [counts[k] for k in tree.order[node.low:node.high]]
        assert dict(zip(found.tolist(), highest.tolist())) == {t: max(c[t] for c in inside) for c in inside for t in c}
        assert least == m[tree.order[node.low:node.high]].min()
        if node.high - node.low > 1:
            children = tree.children(node)
            assert children[0].low == node.low and children[-1].high == node.high
            nodes += children if len(children) > 1 else []
