"""A corpus pipeline: each stage calls one operator of ``codeloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes every stage's rows to the shared
folder before the next stage reads them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, langid, line_dedup, mixing, simhash
from codeloom.llm.common import stash, table

#: Least score of a language prediction that is accepted; only texts that are told no better than by chance go.
LEAST_LANGUAGE_SCORE = 0.3
#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5
#: Entries of the encoder's caches: few, as an executor that ran the other stages has less memory left than a fresh one.
ENCODER_CACHE = (60_000, 40_000)
#: Most rows of an Arrow batch: the JVM and the Python worker both hold batches of whole texts, and Spark's 10,000 rows are much.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; a smaller setting stays. Spark reads it when a plan runs, so it isn't put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language can't be told."""
    _small_batches(spark)
    return langid.accept(docs, langid.learn(docs), LEAST_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of all equal and nearly equal lines."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates."""
    _small_batches(spark)
    return simhash.keep_first(docs, width=SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws whole documents to the sources' target weights; a document may come twice or not at all."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    _small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cache_entries=ENCODER_CACHE)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash_near_dedup", near_dedup), ("mixing", mix_sources), ("byte_bpe", encode)]
#: Trained models, fuzzy hashing and token merges can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
