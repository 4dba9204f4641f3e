"""Exact deduplication with stateful streaming.

A narrow table of fingerprints streams through an aggregation whose state
lives in RocksDB on disk and never expires: no watermark is set.  Per digest
the state retains the stable identifier (the largest doc_id seen) and the
content locator (file and row number of the row that has it).  Hits, digests
seen more than once, are then read back by their locators and checked on their
full bytes, and rows whose bytes differ in spite of an equal digest are grouped
by the bytes themselves.  The locator also says which row stays, so that every
decision is a row's own, whatever ids repeat.

Only DataFrame and Structured Streaming built-ins run here.  Copies of one
text, however many, never meet in one task: every step combines on the map
side first, down to one row per task and digest.

Defined results: a null text is the empty text; empty texts equal each other;
a null doc_id counts as the smallest; rows that repeat a doc_id and text are
each reported and counted, and one of them at most is kept; rows that share a
doc_id but not the text are in groups of their own; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, located, packed, scratch, unpacked, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_MEMORY_MB = 256


LOCATOR = ["at_file", "at_row"]


def _fingerprints(docs: DataFrame, digest_chars: int) -> DataFrame:
    """``docs`` is located."""
    sha = F.sha2(ascii_lower(docs["text"]), 256)
    return (docs.select(docs["doc_id"].alias("doc_id"), sha.alias("text_sha256"), *LOCATOR)
            .withColumn("digest", F.substring("text_sha256", 1, digest_chars)))


def keyed_state(prints: DataFrame, batch_bytes: int = 1 << 28) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, n) for each digest of the Parquet
    table ``prints``, by a streaming aggregation that reads the table in
    micro-batches and whose final state is read back from its checkpoint."""
    spark = prints.sparkSession
    folder, checkpoint = scratch(spark, "prints"), scratch(spark, "state")
    prints.write.parquet(folder)
    stream = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MEMORY_MB),
        # no space is reserved ahead: there may be many small state partitions
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }.items():
        stream.conf.set(key, value)
    keyed = (stream.readStream.schema(prints.schema).option("maxBytesPerTrigger", str(batch_bytes))
             .parquet(folder).groupBy("digest")
             .agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keeper"), F.count(F.lit(1)).alias("n")))
    run = (keyed.writeStream.outputMode("update").format("noop").queryName("exact_dedup")
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()
    schema = "digest string, keep_id {0}, keep_file long, keep_row long, n long".format(
        prints.schema["doc_id"].dataType.simpleString())
    if not run.lastProgress or not run.lastProgress.get("stateOperators"):
        return spark.createDataFrame([], schema), spark.read.schema(prints.schema).parquet(folder)
    state = spark.read.format("statestore").load(checkpoint)
    keeper, n = (f"value.{f.name}" for f in state.schema["value"].dataType.fields)
    state = state.select(F.col("key.digest").alias("digest"), F.col(f"{keeper}.doc_id").alias("keep_id"),
                         F.col(f"{keeper}.at_file").alias("keep_file"), F.col(f"{keeper}.at_row").alias("keep_row"),
                         F.col(n).alias("n"))
    return state, spark.read.schema(prints.schema).parquet(folder)


def _groups(docs: DataFrame, digest_chars: int, batch_bytes: int) -> DataFrame:
    """``exact_groups`` with the locators of the rows; ``docs`` is located."""
    state, prints = keyed_state(_fingerprints(docs, digest_chars), batch_bytes)
    members = written(prints.join(state, "digest"), "members")

    # full bytes on hits: all texts of a digest are equal when the least is the greatest
    hits = members.where("n > 1").select(*LOCATOR, F.col("digest").alias("hit"))
    texts = docs.select("doc_id", "text", *LOCATOR).join(hits, LOCATOR).select(
        "doc_id", *LOCATOR, "hit", ascii_lower(F.col("text")).alias("norm"))
    differ = written(texts.groupBy("hit").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
                     .where("least != greatest").select("hit"), "differ")

    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *LOCATOR]
    kept = ((F.col("at_file") == F.col("keep_file")) & (F.col("at_row") == F.col("keep_row"))).alias("kept")
    plain = members.withColumn("group_size", F.col("n")).withColumn("kept", kept)
    if differ.isEmpty():
        return plain.select(*result)
    plain = plain.join(differ, plain["digest"] == differ["hit"], "left_anti")
    clashing = texts.join(differ, "hit").withColumn("text_sha256", F.sha2("norm", 256))
    by_bytes = clashing.groupBy("hit", "norm").agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keeper"),
                                                   F.count(F.lit(1)).alias("group_size"))
    by_bytes = by_bytes.select("hit", "norm", "group_size", F.col("keeper.doc_id").alias("keep_id"),
                               F.col("keeper.at_file").alias("keep_file"), F.col("keeper.at_row").alias("keep_row"))
    regrouped = clashing.join(by_bytes, ["hit", "norm"]).withColumn("kept", kept)
    return plain.select(*result).unionByName(regrouped.select(*result))


def exact_groups(docs: DataFrame, digest_chars: int = 64, batch_bytes: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  ``digest_chars``
    is the hex length of the state's key; a short one only costs time, as
    bytes decide.
    """
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return _groups(located(docs), digest_chars, batch_bytes).drop(*LOCATOR)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept:
    the one with the largest doc_id, a null one being the smallest.  Of rows
    that repeat that doc_id too, one stays.  Rows of one doc_id and different
    texts, null ids included, do not touch each other."""
    rows = located(packed(docs))
    groups = _groups(rows.select(F.col("row")["doc_id"].alias("doc_id"), "text", *LOCATOR), 64, 1 << 28)
    return unpacked(rows.join(groups.where("kept").select(*LOCATOR), LOCATOR, "left_semi"), docs.columns)
