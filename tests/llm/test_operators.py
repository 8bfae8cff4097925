"""Each operator on awkward rows, and against brute force on small tables."""

import hashlib
import io
import random
import re
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cleanframe.llm import archive, decontaminate, exact, html, nearcopies, packing, quality, sharding, suffixes, toxicity
from cleanframe.llm.queries import all_oracles, all_queries, tokenizer_path
from cleanframe.llm.words import text_sets
from cleanframe.session import write_table
from tests.compare import connect, differences

SMALL = "/root/testdata/sf0.001"
PROSE = " ".join(f"word{i % 97} of line{i % 31} and {i}" for i in range(400))
SCHEMA = "doc_id long, text string, id long, key string, name string, block int, start int, copies int"
ROWS = [
    (1, "one  two\tthree four five six"), (2, None), (3, ""), (4, "   "), (None, "one two three four five six"), (None, None),
    (5, PROSE), (5, PROSE), (6, PROSE.replace("word7", "changed", 1)), (7, PROSE), (8, "short text"), (8, "another text of this id"),
    (9, "é" * 500), (10, "x" * 400), (11, "nothing like the others here, just a plain sentence that stands alone."),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, -1, "k", "n", 1, 2, 3) for i, t in ROWS]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("name", list(all_oracles()))
def test_query_matches_its_sql(spark, name):
    assert differences(spark, connect(SMALL), all_queries()[name], all_oracles()[name], SMALL) is None


# --- Sharding ----------------------------------------------------------------------------

@pytest.mark.parametrize("shards", [1, 8])
def test_shards_have_exact_sizes_and_gapless_slots(spark, rows, shards):
    for df in (rows, spark.range(1000).withColumnRenamed("id", "start")):
        n = df.count()
        found = defaultdict(list)
        out = sharding.shuffle_into_shards(df, shards).collect()
        for r in out:
            found[r.shard].append(r.slot)
        assert len(out) == n and set(found) <= set(range(shards))
        sizes = [len(found[k]) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_shards_of_an_empty_table(nothing):
    assert sharding.shuffle_into_shards(nothing, 8).count() == 0


def test_hypergeometric_draws_follow_the_law(spark):
    draw = sharding.hypergeometric("population", "good", "sample", "u")
    u = F.expr("(id + 0.5D) / 20000")
    out = spark.range(20000).select(u.alias("u"), *(F.lit(v).cast("long").alias(c) for c, v in (("population", 60), ("good", 20), ("sample", 15))))
    values = np.array([r[0] for r in out.select(F.expr(draw)).collect()])
    assert abs(values.mean() - 5) < 0.02
    assert abs(values.var() - 15 * (1 / 3) * (2 / 3) * 45 / 59) < 0.05
    assert values.min() >= 0 and values.max() <= 15


# --- Exact copies ------------------------------------------------------------------------

def test_exact_copies_on_awkward_rows(rows):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_copies(rows).collect())
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    expected = Counter()
    for i, t in ROWS:
        same = groups[norm(t)]
        keep = min((x for x in same if x is not None), default=None)
        expected[i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert got == expected


def test_repeated_rows_match_the_sql(spark, tmp_path):
    data = [*((i, t) for i, t in ROWS if i is not None), (20, PROSE * 3), (20, PROSE * 3), (20, PROSE * 3), (21, PROSE * 3), (3, ""), (8, "short  text")]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in data], pa.int64()), "text": pa.array([t for _, t in data], pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    name = "op4_exact_dedup"
    assert differences(spark, con, all_queries()[name], all_oracles()[name], str(tmp_path)) is None


def test_blocks_of_any_size_name_alike(rows):
    numbered = write_table(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    small = exact.identities(numbered, "number", "doc_id", "text", block=7)
    large = exact.identities(numbered, "number", "doc_id", "text")
    pairs = small.select("row", "level", "name").join(large.select("row", F.col("level").alias("l2"), F.col("name").alias("n2")), ["row"])
    assert pairs.count() == len(ROWS)
    assert pairs.groupBy("level", "name").agg(F.countDistinct("l2", "n2").alias("k")).where("k > 1").isEmpty()
    assert pairs.groupBy("l2", "n2").agg(F.countDistinct("level", "name").alias("k")).where("k > 1").isEmpty()


def test_white_space_of_all_kinds(spark):
    chance = random.Random(5)
    texts = ["".join(chance.choice(" \t\n\x0b\x0c\r\x1fab\u00a0") for _ in range(12)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact.normalised(F.col("text")).alias("n")).collect()
    assert all(r.n == re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in got)


def test_keep_first_leaves_one_row_of_each_group(rows, nothing):
    kept = exact.keep_first(rows)
    assert kept.columns == rows.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 4, 5, 6, 8, 8, 9, 10, 11])
    assert exact.keep_first(nothing).count() == 0


def test_hot_values_are_named_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_HOT", 3)
    df = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    assert exact.keep_first(df).count() == 21


# --- Near copies -------------------------------------------------------------------------

def brute_links(texts):
    sets = list(text_sets(pa.array(texts, pa.string()), 5))
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return links, [find(i) for i in range(len(sets))]


def test_near_copies_against_brute_force(documents, rows):
    for df in (documents, rows.select("doc_id", "text")):
        data = [(r.doc_id, r.text) for r in df.collect()]
        links, roots = brute_links([t for _, t in data])
        heads = defaultdict(list)
        for (i, t), root in zip(data, roots):
            heads[root].append(i)
        expected = Counter((i, min((x for x in heads[root] if x is not None), default=None), n) for (i, _), root, n in zip(data, roots, links))
        assert Counter((r.id, r.class_id, r.n_links) for r in nearcopies.near_copies(df).collect()) == expected


def test_large_nodes_split_and_compare_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LEAF_SETS", 4)
    monkeypatch.setattr(nearcopies, "BLOCK_SETS", 8)
    words = PROSE.split()
    texts = [" ".join(words[:200] + [f"end{i}"]) for i in range(30)] + [" ".join(words[:40] + [f"w{i}x{k}" for k in range(160)]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.id: (r.class_id, r.n_links) for r in nearcopies.near_copies(df).collect()}
    assert all(out[i] == (0, 29) for i in range(30))
    assert all(out[i] == (i, 0) for i in range(30, 60))


def test_keep_one_keeps_columns_and_one_of_each_class(rows, nothing):
    kept = nearcopies.keep_one(rows)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9, 10, 11, None}
    assert nearcopies.keep_one(nothing).count() == 0


def test_keep_one_keeps_one_row_of_classes_with_null_or_repeated_ids(spark, rows):
    assert Counter(r.doc_id for r in nearcopies.keep_one(rows).collect()) == Counter([1, 2, 3, 4, 5, 8, 8, 9, 10, 11, None])
    words = PROSE.split()
    data = [(i, " ".join(words[at:at + 60] + [f"end{k}"])) for i, at in ((None, 0), (50, 100), (60, 200)) for k in (1, 2, 2, 3)]
    data += [(None, words[at]) for at in range(5)] + [(61, data[-1][1])]
    out = nearcopies.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in out) == Counter([None, 50, 60] + [None] * 5)
    assert set(out) <= set(data)


def test_texts_are_picked_once_whatever_the_ids(spark, monkeypatch):
    """Sets that share nodes meet one row each, though all rows have one id."""
    tables = {}
    write = nearcopies.write_table

    def noted(df, purpose):
        tables[purpose] = write(df, purpose)
        return tables[purpose]

    monkeypatch.setattr(nearcopies, "write_table", noted)
    texts = [" ".join(PROSE.split()[:60] + [f"end{k // 2}"]) for k in range(40)]
    for i in (None, 3):
        df = spark.createDataFrame([(i, t) for t in texts], "doc_id long, text string")
        assert {(r.class_id, r.n_links) for r in nearcopies.near_copies(df).collect()} == {(i, 39)}
        assert tables["active"].count() == 20


# --- Repeated passages -------------------------------------------------------------------

def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        covered = [False] * len(r)
        for i in range(len(r) - 199):
            if seen[r[i:i + 200]] > 1:
                covered[i:i + 200] = [True] * 200
        kept = bytes(c for c, gone in zip(r, covered) if not gone)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [30_000, 0])
def test_repeated_passages_against_brute_force(rows, hot):
    shared = " ".join(f"shared{i}" for i in range(40))
    more = [(20 + i, f"{PROSE[i * 37:i * 37 + 300]} own{i} {shared} tail{i} {PROSE[i:i + 230]}") for i in range(4)] + [(30, "abc" * 200 + shared)]
    extra = rows.sparkSession.createDataFrame(more, "doc_id long, text string")
    df = rows.select("doc_id", "text").unionByName(extra)
    data = ROWS + more
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_passages(df, hot_contexts=hot).collect())
    assert got == Counter((i, *v) for (i, _), v in zip(data, brute_removed([t for _, t in data])))


def test_repeated_passages_of_an_empty_table(nothing):
    assert suffixes.repeated_passages(nothing).count() == 0


# --- Quality -----------------------------------------------------------------------------

def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = quality.scored(docs, quality.fit(docs)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = out.select(F.avg(((F.col("quality_score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


def test_quality_of_awkward_rows(rows, nothing, documents):
    model = quality.fit(documents)
    out = quality.scored(rows, model)
    assert out.columns[:-2] == rows.columns and out.count() == len(ROWS)
    assert all(r.quality_score == 0 for r in out.where("text is null or trim(text) = ''").collect())
    assert quality.scored(nothing, quality.fit(nothing)).count() == 0


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.7
    wrong = rng.random((5000, quality.LABELLERS)) < 0.15
    patterns = np.where(truth[:, None] ^ wrong, quality.GOOD, quality.BAD)
    share, table = quality.fit_accuracies(patterns, np.ones(5000))
    assert abs(share - 0.7) < 0.05
    assert np.abs(table[1, :, quality.GOOD] - 0.85).max() < 0.05


# --- Pages -------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav>
<div class="ad">Buy now</div><article><h1>The   title</h1><p>First &amp; <b>bold<br>line.<p>Second, a much longer paragraph with several words in it.</p>
<div class="share">Share this</div></article><div id="comments"><p>I disagree.</p></div><form><textarea>write</textarea></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    trees = html.fit(pages)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (4, "u", "<p"), (5, "u", "<div>" * 3000), (6, None, "<script>if (a<b)</script><!-- x")]
    out = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), trees)
    text = {r.page_id: r.main_text for r in out.collect()}
    assert text[1] == "The title\nFirst & bold line.\nSecond, a much longer paragraph with several words in it."
    assert all(text[k] == "" for k in (2, 3, 4, 5, 6))
    for r in html.extracted(pages, trees).limit(20).collect():
        first = re.search(r"<article>.*?<p>(?:<b>)?([^<&]{20})", r.html, re.S)
        assert not first or first.group(1).strip() in r.main_text
        assert "©" not in r.main_text
    assert html.extracted(pages.limit(0), html.fit(pages.limit(0))).count() == 0


def test_copies_of_a_page_enter_the_sample_once(spark, monkeypatch):
    sizes = []

    def counted(df, purpose):
        sizes.append(df.count())
        return df.limit(0)

    monkeypatch.setattr(html, "write_table", counted)
    rows = [(k, "u", PAGE.replace("First", f"First {k}")) for k in range(5)]
    for more in ([], [(9, "u", rows[0][2])] * 20):
        html.fit(spark.createDataFrame(rows + more, "page_id long, url string, html string"))
    assert sizes[0] == sizes[1] > 0


def test_decoding_never_contradicts():
    page = html.Page("<div><div><p>a</p><p>b</p></div><p>c</p></div>")
    rng = np.random.default_rng(1)
    for _ in range(50):
        text = page.main_text(rng.random(len(page.tag)))
        assert text in ("", "a", "b", "c", "a\nb", "a\nc", "b\nc", "a\nb\nc")


# --- Packing -----------------------------------------------------------------------------

def test_packing_is_exact(rows, documents):
    encoder = packing.WordEncoder(tokenizer_path())
    for df in (rows.select("doc_id", "text"), documents):
        data = [(r.doc_id, r.text or "") for r in df.collect()]
        out = packing.pack(df, tokenizer_path()).collect()
        expected = Counter()
        for i, t in data:
            ids = [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
            for start in range(0, len(ids), 2048):
                part = np.array(ids[start:start + 2048], dtype="<u4").tobytes()
                expected[i, start, len(part) // 4, zlib.crc32(part), len(ids)] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == expected
        windows = defaultdict(list)
        for r in out:
            windows[r.sequence_id].append((r.offset, r.length))
        for parts in windows.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 2048


def test_packing_of_an_empty_table(nothing):
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_unusual_texts_are_encoded_like_the_tokenizer():
    encoder = packing.WordEncoder(tokenizer_path())
    texts = ["İstanbul ΣΑΣ", "don't it's", "a²b ½ 12_3", "é <|endoftext|>", "\x1c a\x85b\xa0c", "naïve—‘q’", "日本", "x'", None, "Œ ſ ŉ"]
    for got, t in zip(encoder.encode(pa.array(texts)), texts):
        assert got.tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


# --- Decontamination ---------------------------------------------------------------------

def test_substituted_passages_are_found(spark, rows, nothing):
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil strange green potions at noon today"
    changed = item.replace("lazy", "sleepy").replace("strange", "odd")
    texts = [(1, f"some words before {changed} and after"), (2, item.upper()), (3, "the quick brown fox and nothing else of it at all, just other words"), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "tiny")], "item_id long, text string")
    out = {r.doc_id: r.overlaps for r in decontaminate.overlaps(df, benchmark).collect()}
    assert [o.item_id for o in out[1]] == [7] and [o.item_id for o in out[2]] == [7]
    assert (out[1][0].start_word, out[1][0].end_word, out[1][0].matched_words) == (3, 22, 17)
    assert not out[3] and not out[4]
    assert decontaminate.overlaps(rows, benchmark).where("size(overlaps) > 0").isEmpty()
    assert decontaminate.overlaps(nothing, benchmark.limit(0)).count() == 0


def test_benchmark_blocks_give_the_same(documents, spark, monkeypatch):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = Counter((r.doc_id, o.item_id) for r in decontaminate.overlaps(documents, benchmark).collect() for o in r.overlaps)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert whole == Counter((r.doc_id, o.item_id) for r in decontaminate.overlaps(documents, benchmark).collect() for o in r.overlaps)
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for d in documents.collect():
        for i, t in items:
            if t in (d.text or "") and len(t.split()) >= 14:
                assert (d.doc_id, i) in whole


def test_a_diagonal_counts_if_any_of_its_runs_does(spark):
    rng = np.random.default_rng(5)

    def marks(*lengths):
        return np.concatenate([np.full(n, k % 2 == 0) for k, n in enumerate(lengths)])

    cases = [marks(12, *[1, 3] * 22), marks(12, 5, 12, 5, 12), marks(11, 9, 4, 1, 4, 1, 4, 1), marks(11, 4, 11)]
    cases += [rng.random(rng.integers(1, 70)) >= rng.choice([0.1, 0.22, 0.3, 0.4]) for _ in range(400)]
    for same in cases:
        n = np.concatenate([[0], np.cumsum(same)])
        brute = max((n[b] - n[a] for b in range(len(n)) for a in range(b) if n[b] - n[a] >= 12 and 10 * (n[b] - n[a]) >= 8 * (b - a)), default=None)
        item = np.arange(len(same), dtype=np.uint64)
        found = decontaminate.diagonal_overlaps(np.concatenate([[999], np.where(same, item, 1000 + item)]), item, 1)
        assert max((k for *_, k in found), default=None) == brute
        assert all(same[a - 1:b - 1].sum() == k >= 12 and 10 * k >= 8 * (b - a) for a, b, k in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    words = [f"w{k}" for k in range(100)]
    df = spark.createDataFrame([(k, " ".join(w if s else f"new{w}" for w, s in zip(words, same))) for k, same in enumerate(cases[:2])], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {r.doc_id: r.overlaps[0].item_id for r in decontaminate.overlaps(df, benchmark).collect() if r.overlaps} == {0: 7, 1: 7}


# --- Archives ----------------------------------------------------------------------------

def test_archives_round_trip(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a\r\nb", page), (1, None, page), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (1, "v", page), (None, "u", page), (7, "u", "é" * 90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = archive.verified(archive.read_archives(archive.write_archives(df))).collect()
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out)
    expected = Counter()
    for i, _, text in rows:
        raw = (text or "").encode()
        again = text == page and i != 1
        expected[i, len(raw), "revisit" if again else "response", 1 if again else None, None if again else raw] += 1
    assert got == expected
    assert archive.read_archives(archive.write_archives(df.limit(0))).count() == 0


def test_large_ids_stay_exact(spark):
    big = 2 ** 62 + 1
    page = "<p>" + "x" * 200
    rows = [(big, page), (big + 2, page), (None, "short"), (big + 4, "other"), (-big, None), (None, page)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").coalesce(1)
    out = archive.verified(archive.read_archives(archive.write_archives(df))).collect()
    assert Counter((r.page_id, r.refers_to) for r in out) == Counter((i, big if t == page and i != big else None) for i, t in rows)


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, offset):
        return self.raw[offset:offset + n]


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 10])
def test_directories_are_parsed_with_and_without_zip64(monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    sink = io.BytesIO()
    archive.write_package(sink, [(k, "u", b"payload %d" % k, "d", "response", None) for k in range(5)])
    raw = sink.getvalue()
    members = archive.central_directory(Bytes(raw), len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        for info in package.infolist():
            at = archive.member_start(Bytes(raw), members[info.filename])
            assert raw[at:at + members[info.filename][1]] == package.read(info)
    assert len(archive.package_index(Bytes(raw), len(raw))) == 5


# --- Toxicity ----------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark, rows, nothing):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out("doc_id")), model)
    right = out.select(F.avg(((F.col("toxicity") >= 0.5).cast("int") == F.col("toxic")).cast("double"))).first()[0]
    assert right > 0.97
    found = toxicity.scored(rows, model)
    assert found.columns[:-2] == rows.columns
    assert all(0 <= r.toxicity < 0.5 and not r.toxic_spans for r in found.where("text is null or text = ''").collect())
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels.limit(0))).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=5), rng.normal(size=(2, 2))
    weights = {}
    for code in range(32):
        path = [code >> k & 1 for k in range(5)]
        weights[tuple(path)] = np.exp(sum(s for s, p in zip(scores, path) if p) + sum(move[a, b] for a, b in zip(path, path[1:])))
    total = sum(weights.values())
    expected = [sum(w for p, w in weights.items() if p[k]) / total for k in range(5)]
    chance, moves, log_partition = toxicity.marginals(scores, np.array([0, 5]), move)
    assert np.allclose(chance, expected) and np.isclose(log_partition, np.log(total))
    assert np.isclose(moves.sum(), 4)


def test_chains_are_whole_documents():
    """Long, short and empty documents against a walk word by word over each of them."""
    rng = np.random.default_rng(5)
    sizes = [3, 0, 64, 65, 1, 1000, 128, 7001, 0]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    scores, move = rng.normal(scale=3, size=rows[-1]), rng.normal(scale=2, size=(2, 2))
    expected, total = [], 0.0
    for a, b in zip(rows[:-1], rows[1:]):
        if a == b:
            continue
        there, back = np.zeros((b - a, 2)), np.zeros((b - a, 2))
        for k in range(b - a):
            own = np.array([0, scores[a + k]])
            there[k] = own if k == 0 else own + np.logaddexp(there[k - 1][0] + move[0], there[k - 1][1] + move[1])
        for k in range(b - a - 2, -1, -1):
            ahead = back[k + 1] + np.array([0, scores[a + k + 1]])
            back[k] = np.logaddexp(move[:, 0] + ahead[0], move[:, 1] + ahead[1])
        both = there + back
        expected.append(1 / (1 + np.exp(both[:, 0] - both[:, 1])))
        total += np.logaddexp(*there[-1])
    for group in (toxicity.GROUP, 3):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "GROUP", group)
            chance, moves, log_partition = toxicity.marginals(scores, rows, move)
        assert np.allclose(chance, np.concatenate(expected)) and np.isclose(log_partition, total)
        assert np.isclose(moves.sum(), sum(max(0, n - 1) for n in sizes))
    none = toxicity.marginals(np.empty(0), np.array([0, 0, 0]), move)
    assert len(none[0]) == 0 and none[2] == 0


def test_sample_keeps_its_bounds(spark, monkeypatch):
    """One text of a repeated id enters the fit, and texts beyond the bound in bytes do not."""
    taken = []
    monkeypatch.setattr(toxicity, "token_labels", lambda words, toxic: taken.append(np.diff(words.rows)) or np.zeros(len(words.hashes), int))
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5][:3]
    docs = [(ids[0], f"word{k} again") for k in range(500)] + [(ids[1], "a good text"), (ids[2], "long " * 3000)]
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10_000)
    toxicity.fit(docs, labels)
    assert [sorted(t.tolist()) for t in taken] == [[2, 3, 3000], [2, 3]]


def test_plain_pages_keep_their_text(spark):
    plain = "<html><body><nav><a href=/>Home</a><a href=/b>More</a></nav><h1>Title</h1><p>First words.</p><div>Second <b>words</b>.</div><footer>made by us</footer></body></html>"
    df = spark.createDataFrame([(1, plain), (2, "<p>Only this.</p>"), (3, None)], "page_id long, html string")
    out = {r.page_id: r.main_text for r in html.extracted(df, html.fit(df)).collect()}
    assert out == {1: "Title\nFirst words.\nSecond words.", 2: "Only this.", 3: ""}


def test_unmatched_tags_take_linear_time():
    n = 20_000
    started = time.time()
    html.Page("<div>" * n + "</section>" * n + "<li>x</li><p>y" * n)
    assert time.time() - started < 10


def test_matrix_is_drawn_in_many_tasks(spark):
    sizes = spark.range(64).select(F.col("id").alias("block"), F.lit(40).cast("long").alias("n"))
    matrix = sharding.communication_matrix(sizes, 64, "transform(sequence(1, 32), t -> 80L)", 3)
    assert matrix.rdd.getNumPartitions() == 8  # the nodes of the third level
    rows = matrix.collect()
    assert len(rows) == 64 and all(sum(r.counts) == 40 for r in rows)
    assert [sum(c) for c in zip(*(r.counts for r in rows))] == [80] * 32


def test_scorer_reads_whole_texts(spark):
    """A sampled text enters with all its words: what is at its end counts like the rest."""
    bad = "#### %%%% $$$$ " * 400
    rows = [(i, ("the quiet words of a plain text. " * 200 if i % 2 else bad) + f"mark{i % 2} " * 300) for i in range(60)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    score, _ = model.score(pa.array(["mark1 " * 50, "mark0 " * 50]))
    assert score[0] > score[1]


def test_scorer_of_counts_is_that_of_repeats():
    labels = np.array([1.0, 0.0])
    repeated = quality.fit_scorer([np.array([3, 3, 5]), np.array([7, 9])], [np.ones(3, int), np.ones(2, int)], labels, 20)
    counted = quality.fit_scorer([np.array([3, 5]), np.array([7, 9])], [np.array([2, 1]), np.ones(2, int)], labels, 20)
    assert np.allclose(repeated, counted)
