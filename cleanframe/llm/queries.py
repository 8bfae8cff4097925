"""The registered query of each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archive, bytepair, decontaminate, exact, html, nearcopies, packing, quality, ranking, sharding, suffixes, toxicity
from cleanframe.session import write_table

from .registry import _oracles, _queries, query, table


def all_queries():
    return dict(_queries)


def all_oracles():
    return dict(_oracles)


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shuffle_into_shards(sharding.sized(table(spark, folder, "documents")), 8)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op4_exact_dedup", r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)""")
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_copies(table(spark, folder, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query("op9_warc", """
with t as (select page_id, coalesce(html, '') as html from pages),
g as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first from t)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first <> page_id then first end as refers_to
from g""")
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = archive.read_archives(archive.write_archives(table(spark, folder, "pages")))
    return archive.verified(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = quality.scored(docs, quality.fit(docs))
    return out.select("doc_id", "quality_score", "weak_label", (F.col("quality_score") >= 0.5).alias("kept"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = decontaminate.overlaps(docs, table(spark, folder, "benchmark"))
    return out.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("overlaps.item_id")).alias("item_ids"), "overlaps",
    )


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = nearcopies.near_copies(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, folder, "labels")), into="score")
    return out.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "toxic_spans",
    )


@query("op6_html")
def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    out = html.extracted(pages, html.fit(pages), into="text")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, folder, "documents")).drop("kept")


_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as words from documents),
i as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
c as (select count(*) filter (len(words) > 0) as nn, sum(len(words))::bigint as ll from d),
m as (select r, doc_id, 50 + (50 * len(words) * nn) // ll as m from d, c where len(words) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(words) as term from d) where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from t group by 1), c),
s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from i join t using (term) join w using (term) join m using (r) group by all)
select item_id, (row_number() over o)::int as rank, doc_id, score from s where score > 0
window o as (partition by item_id order by score desc, doc_id) qualify row_number() over o <= 50""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.alignments(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = found.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id())
    found = write_table(found, "aligned")
    counts = write_table(alignment.pair_counts(found), "pair_counts")
    return alignment.link_sums(found, counts, "row").drop("row")


@query("op13_byte_pairs")
def op13_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = bytepair.decoded(bytepair.encoded(docs, path, pattern).drop("text"), path, pattern)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
