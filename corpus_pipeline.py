"""Documents to training tokens: each stage reads what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Null and repeated rows are each
operator's defined cases; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from tessera.llm.common import scratch
from tessera.session import ship_package, short_batches
from tessera.sources.tables import table


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    short_batches(spark)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go; ``lang`` is kept as it is."""
    _ready(spark)
    return language_id.in_a_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the largest doc_id stays."""
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the smallest doc_id stays."""
    _ready(spark)
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    _ready(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, and the digest of the decoded text."""
    _ready(spark)
    decoded = bpe.encode_and_decode(docs, bpe.word_bpe_file())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", languages), ("exact_dedup", exact_copies), ("near_duplicates", near_copies),
          ("decontamination", benchmark_free), ("bpe", tokens)]

#: Language ID is a trained model: SQL cannot express its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
