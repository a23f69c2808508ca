"""The registered query of each operator, with its production parameters over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, jaccard, language, packing, sharding, topk, toxicity, urlfilter, warc
from .common import held_out, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard and slot under the law `rows`, with its size and the checksum of its text."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probability of being toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


RULES = [
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict. A page's label is that of the document whose number its path ends with;
    low quality and toxic ones are bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = urlfilter.parsed(F.col("url"))
    numbered = pages.select("page_id", F.regexp_extract(path, "([0-9]+)[^0-9/]*/?$", 1).try_cast("long").alias("doc_id"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return urlfilter.judge(pages, numbered.join(marks, "doc_id").select("page_id", "bad"), RULES)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class and number of links: five words, similarity of 0.8 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found to every fiftieth."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every hundredth."""
    return topk.search(table(spark, sf_dir, "documents"), every=100, k=10)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold when they are read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs)
    return language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_toxicity,
        op3_best_fit_packing,
        op4_byte_bpe,
        op5_url_filters,
        op6_ngram_jaccard_join,
        op7_nearest_neighbours,
        op8_bm25_topk,
        op9_warc,
        op10_language_id,
    )
}

#: The others are not plain SQL over the tables, or too slow in it. tests/llm holds each against a brute-force version, but
#: for op1, whose random order has only laws to hold, and the fits of op2 and op10, whose counts and sums are held so.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
}
