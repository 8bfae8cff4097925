"""The pipeline's stages take effect and keep the columns of documents."""

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from cleanframe.llm import decontaminate, nearcopies, quality

SMALL = "/root/testdata/sf0.001"
HELPERS = (
    "row", "Quality_Score", "weak_label", "OVERLAPS", "id", "name", "level", "digest", "content", "blocks", "keep_id", "keep_row", "n", "pos",
    "key", "node", "size", "first", "copies", "item", "stays", "turn", "shard", "bucket",
)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # Columns with the names of helpers, in other letters too, stay as they are.
    docs = docs.withColumns({c: F.lit(c) for c in HELPERS})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        given, docs = docs, corpus_pipeline.write_table(stage(spark, docs, SMALL), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and docs.where(" or ".join(f"{c} <> '{c}'" for c in HELPERS)).isEmpty()
        assert set(after.items()) <= set(before.items())
        if name == "exact_dedup":
            assert set(after.values()) == set(before.values()) and len(set(after.values())) == len(after)
        if name == "near_dedup":
            assert set(after) == {r.class_id for r in nearcopies.near_copies(given).collect()}
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.overlaps(docs, benchmark).where("size(overlaps) > 0").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert quality.scored(empty, quality.fit(empty)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def own_table(spark, folder, texts):
    """Folder with documents of unique ids, some of them copies and near copies, and a benchmark."""
    data = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts, -20)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "nothing of these twelve words or more stands in any of the documents here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def mixed_texts():
    chance = random.Random(3)
    texts = [" ".join(f"{chance.getrandbits(40):x}" for _ in range(150)) for _ in range(120)]
    return [*texts, *(t.replace(" ", "  ", 1) for t in texts[:20]), *(f"{t} end" for t in texts[20:60]), *(f"{t} ende" for t in texts[40:60]), "", " ", None]


def scratch_bytes(spark):
    """Bytes of the scratch tables by purpose."""
    found = Counter()
    for path in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).rglob("*.parquet"):
        found[path.parent.name.split("-")[1]] += path.stat().st_size
    return found


def test_stages_that_drop_copies_leave_no_copy_of_the_table(spark, tmp_path):
    docs = own_table(spark, tmp_path, mixed_texts())
    table = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    # 120 texts, 20 exact copies, 60 near copies; then an empty text, a space and null.
    for name, left in (("exact_dedup", [*range(-20, 100), *range(120, 182)]), ("near_dedup", [*range(-20, 100), 180, 181, 182])):
        before = scratch_bytes(spark)
        stage = dict(corpus_pipeline.STAGES)[name]
        assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == left
        assert (scratch_bytes(spark) - before).total() < 0.1 * table


def test_run_drops_what_its_stages_read(spark, tmp_path):
    own_table(spark, tmp_path, mixed_texts())
    before = scratch_bytes(spark)
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not set(scratch_bytes(spark) - before) & {"quality", "exact_dedup", "near_dedup", "numbered"}
    assert (tmp_path / "documents.parquet").exists() and (tmp_path / "benchmark.parquet").exists()
