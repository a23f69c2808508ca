"""A corpus pipeline: toxic documents go, then those of no language, then near copies; what is left is packed.

Each stage takes (spark, docs, sf_dir) and is written as Parquet, which the next stage reads. Stages work on all that
their predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import jaccard, language, packing, toxicity
from granary.llm.common import fresh, ship, staged, table

#: A document is toxic from this probability on.
TOXIC = 0.3
#: A document's words are of no language if, on the average, each word's own language is less likely than this.
LEAST_CLEAR = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below TOXIC. The model learns from the labelled rows of `docs`.

    Null, empty and wordless texts get the share of toxic labels and so stay where that is below TOXIC; whole texts are
    scored, however long; equal texts go or stay together, and each of repeated rows is judged. No rows give no rows.
    """
    ship(spark)
    (score,) = fresh(docs, "score")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into=score).filter(F.col(score) < TOXIC).drop(score)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have words, each of which is clearly of some language (not of the same one: texts that switch
    between languages stay).

    Null texts, empty ones and those without a letter are of no language and go. Whole texts are read, however long;
    equal texts and repeated rows go or stay together. Where no document names a language, none has one, and all go.
    """
    ship(spark)
    name, share, clear = fresh(docs, "lang_pred", "share", "clear")
    named = language.identify(docs, language.learn(docs), into=(name, share, clear))
    return named.filter((F.col(name) != language.UNKNOWN) & (F.col(clear) >= LEAST_CLEAR)).drop(name, share, clear)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id.

    Repeated rows are copies, of which one stays; a row with a null doc_id stays only where its class has no other;
    ties of doc_id are broken by the text's digest and then by the other columns. Texts without words (null, empty) are
    copies of nothing and all stay. Whole texts are compared, however long. No rows give no rows.
    """
    ship(spark)
    return jaccard.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens.

    Null and empty texts are one end token; texts of more tokens than a sequence are cut into pieces; repeated rows and
    equal texts are packed each; a null doc_id is kept. No rows give no rows.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Its stages fit models, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
