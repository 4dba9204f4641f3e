"""Corpus streams (ST5, ST6)."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import prompts as PR
from tessera.functions.text import py_strip, strip_placeholder
from tessera.operators import fields, gates
from tessera.operators.ranking import assign_shards
from tessera.sources.feature_cache import build_manifest, write_manifest


def build_samples(df: DataFrame, n_img_col: str = "num_patches",
                  default_prompt: str = K.DEFAULT_HUMAN_PROMPT) -> DataFrame:
    """ST5: sample construction for the array form of the corpus
    (``conversations ARRAY<STRUCT<from, value>>``).  Every step is a
    row-wise expression, so the same function serves a batch DataFrame and
    a ``readStream`` one: last turns (P3) -> strip (P4) -> default (P5) ->
    F1 asset, F2 assistant -> prompt (P7) and terminated answer (P13)."""
    h, a = fields.last_turns_array("conversations")
    s = df.select("sample_id", "image_ref", n_img_col,
                  F.when(h.isNull(), F.lit(default_prompt)).otherwise(strip_placeholder(h)).alias("human"),
                  F.coalesce(py_strip(a), F.lit("")).alias("assistant"))
    s = gates.require_assistant(gates.require_asset(s, "image_ref"), "assistant")
    return s.select("sample_id", PR.render_prompt("human", F.col(n_img_col)).alias("prompt"),
                    PR.answer_text("assistant").alias("answer"))


def to_array_form(long: DataFrame) -> DataFrame:
    """Long-form turns (one row per turn) to the array form of D1; one
    aggregation per sample (its turns only)."""
    g = long.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.col("speaker").alias("from"), "value"))).alias("_t"),
        F.first("image_ref", ignorenulls=True).alias("image_ref"), F.max("num_patches").alias("num_patches"))
    return g.select("sample_id", "image_ref", "num_patches",
                    F.transform("_t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value")))
                    .alias("conversations"))


def _read_state(spark, root: str, batch_id: int):
    """(next_shard, carry_rows, carry frame or None) left by ``batch_id``."""
    if batch_id < 0:  # before the first batch; any other state must be readable
        return 0, 0, None
    m = spark.read.parquet(os.path.join(root, "_progress", f"batch_id={batch_id}")).first()
    carry = None
    if m["carry_rows"] > 0:
        carry = spark.read.parquet(os.path.join(root, "_carry", f"batch_id={batch_id}"))
    return int(m["next_shard"]), int(m["carry_rows"]), carry


def _write_state(spark, root: str, batch_id: int, next_shard: int, carry: DataFrame | None, n_carry: int):
    if carry is not None and n_carry > 0:
        carry.write.mode("overwrite").parquet(os.path.join(root, "_carry", f"batch_id={batch_id}"))
    spark.createDataFrame([(next_shard, n_carry)], "next_shard long, carry_rows long") \
        .coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "_progress", f"batch_id={batch_id}"))


def stream_cache(df: DataFrame, root: str, order_col: str, shard_size: int, checkpoint: str,
                 trigger: dict | None = None):
    """ST6: one-pass feature cache with full shards.  Each micro-batch is
    joined by the rows carried over from the previous one, ranked, and only
    whole shards (``shard_size`` rows, ids continuing from the previous
    batch) are written, under ``shards/batch_id=<id>/``; the remainder is
    carried to the next batch.  Carry and progress are stored per batch id,
    so a replayed batch recomputes from the same inputs and overwrites its
    own output (idempotent sink).  ``flush_cache`` writes the final partial
    shard once the stream has stopped.  Only counts and one progress row
    pass through the driver."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        next_shard, n_prev, carry = _read_state(spark, root, batch_id - 1)
        rows = (batch if carry is None else batch.unionByName(carry)).persist()   # read by 4 jobs
        n = rows.count()
        n_full = (n // shard_size) * shard_size
        if n == 0:
            _write_state(spark, root, batch_id, next_shard, None, 0)
            rows.unpersist()
            return
        ranked = assign_shards(rows, [order_col], shard_size)
        ranked = ranked.withColumn("_r", F.col("shard_id") * shard_size + F.col("pos"))
        if n_full:
            full = ranked.where(F.col("_r") < n_full) \
                .withColumn("shard_id", F.col("shard_id") + F.lit(next_shard)).drop("_r")
            full.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id") \
                .parquet(os.path.join(root, "shards", f"batch_id={batch_id}"))
        rest = ranked.where(F.col("_r") >= n_full).drop("_r", "shard_id", "pos")
        _write_state(spark, root, batch_id, next_shard + n_full // shard_size, rest, n - n_full)
        rows.unpersist()

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def flush_cache(spark, root: str, order_col: str, shard_size: int, dataset: str = "stream",
                config: str = "default") -> None:
    """Write the rows still carried after the last batch as a final (partial)
    shard, clear the carry, and write the manifest (S5) of all shards.  A
    stream resumed later goes on with the next shard id; a repeated flush
    rewrites the same files."""
    try:
        last = spark.read.parquet(os.path.join(root, "_progress")).select(F.max("batch_id")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return  # no batch has run
    last = int(last)
    next_shard, n_carry, carry = _read_state(spark, root, last)
    if carry is not None and n_carry > 0:
        rest = assign_shards(carry, [order_col], shard_size) \
            .withColumn("shard_id", F.col("shard_id") + F.lit(next_shard))
        rest.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id") \
            .parquet(os.path.join(root, "shards", f"batch_id={last}-rest"))
        _write_state(spark, root, last, next_shard + 1, None, 0)
    shards = spark.read.parquet(os.path.join(root, "shards")).select("shard_id")
    write_manifest(build_manifest(shards, dataset, config, shard_size=shard_size), root)
