"""Streaming operators run as incremental queries over files derived from
the tables (ST1-ST6).  Each runs with ``availableNow`` (all files present,
in several micro-batches) into a file sink in the checkpoint folder and is
read back; the oracle is the SQL of the batch form it must equal."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.logs import PARSED_SQL, SAVE_EVERY, step_log_folder
from tessera.plans.registry import query
from tessera.plans.samples import IMG4, _turn_sql
from tessera.session import checkpoint_dir
from tessera.streaming import corpus as SC
from tessera.streaming import logs as SL

ACCUM = 32
TRIGGER_STEP = 1000


def _scratch(spark, tag: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def _append_to_files(df, spark, tag: str):
    root = _scratch(spark, tag)
    q = df.writeStream.format("parquet").option("path", os.path.join(root, "out")) \
        .option("checkpointLocation", os.path.join(root, "ckpt")).outputMode("append") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(os.path.join(root, "out"))


def _logq(body: str) -> str:
    return with_fixtures(body, "step_log", extra={"parsed": PARSED_SQL})


@query("stream_latest", _logq("select stage, max(step) as latest_step, arg_max(loss, step) as latest_loss "
                              "from parsed group by stage"))
def stream_latest(spark, sf):
    """ST1: newest step per stage, complete mode; each micro-batch rewrites
    the (one row per stage) result table."""
    root = step_log_folder(spark, sf)
    out = _scratch(spark, "stream-latest")
    log = SL.read_step_log_stream(spark, root, max_files_per_trigger=16)

    def sink(df, bid):
        df.write.mode("overwrite").parquet(os.path.join(out, "table"))
    q = SL.stream_latest(log).writeStream.outputMode("complete").foreachBatch(sink) \
        .option("checkpointLocation", os.path.join(out, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(os.path.join(out, "table"))


@query("stream_trigger", _logq(f"select distinct stage from parsed where step >= {TRIGGER_STEP}"))
def stream_trigger(spark, sf):
    """ST2: each stage fires once when it reaches the step; the action
    appends the firing stages to a folder (one write per micro-batch,
    keyed by batch id so a replay overwrites)."""
    root = step_log_folder(spark, sf)
    out = _scratch(spark, "stream-trigger")

    def action(df, bid):
        df.select("stage").write.mode("overwrite").parquet(os.path.join(out, "fired", f"batch={bid}"))
    q = SL.stream_trigger(SL.read_step_log_stream(spark, root, max_files_per_trigger=16), TRIGGER_STEP, action,
                          os.path.join(out, "ckpt"), {"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(os.path.join(out, "fired")).select("stage")


@query("stream_accum", with_fixtures(f"""
select stage, w + 1 as step, round(avg(loss), 9) as loss, count(*) as n
from (select stage, micro_idx // {ACCUM} as w, loss from microsteps) q
group by stage, w having count(*) = {ACCUM}""", "microsteps"))
def stream_accum(spark, sf):
    """ST3: count-window mean loss as micro-step files arrive."""
    src = _scratch(spark, "microsteps")
    micro = FX.microsteps(spark, sf)
    micro.write.parquet(src)
    stream = spark.readStream.schema(micro.schema).option("maxFilesPerTrigger", 4).parquet(src)
    out = _append_to_files(SL.stream_accum(stream, ACCUM), spark, "stream-accum")
    return out.select("stage", "step", F.round("loss", 9).alias("loss"), "n")


@query("stream_best", _logq(f"""
select stage, step, loss,
  coalesce(min(loss) over (partition by stage order by step rows between unbounded preceding and 1 preceding),
           'inf'::double) as prev_best,
  loss < coalesce(min(loss) over (partition by stage order by step rows between unbounded preceding and 1 preceding),
           'inf'::double) as is_new_best
from parsed where step % {SAVE_EVERY} = 0 and loss is not null"""))
def stream_best(spark, sf):
    """ST4: the running best revised as log files arrive; the newest row of
    each save point."""
    root, out = step_log_folder(spark, sf), _scratch(spark, "stream-best")
    q = SL.start_running_best(spark, lambda s: SL.read_step_log_stream(s, root, max_files_per_trigger=16), SAVE_EVERY,
                              os.path.join(out, "rows"), os.path.join(out, "ckpt"))
    q.awaitTermination()
    return SL.newest_revisions(spark, os.path.join(out, "rows"))


@query("stream_samples", with_fixtures(f"""
select sample_id,
  '[@BOS@]<|start_of_turn|>user' || chr(10) || {IMG4.format(n="num_patches")} || chr(10) || human
    || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) as prompt,
  assistant || '<|end_of_turn|>' as answer
from lt where assistant <> '' and sample_id in (select sample_id from vl_conv where image_ref is not null)""",
    "vl_conv", extra={"lt": _turn_sql("Describe this image.")}))
def stream_samples(spark, sf):
    """ST5: the array form of the corpus arrives as files; samples are built
    by the same row-wise function as in batch."""
    src = _scratch(spark, "conv-array")
    arr = SC.to_array_form(FX.vl_conv(spark, sf))
    arr.write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    return _append_to_files(SC.build_samples(stream), spark, "stream-samples")


@query("stream_cache", """
select shard_id, count(*) as n_rows from (
  select (row_number() over (order by vec_id) - 1) // 64 as shard_id from embeddings) q group by shard_id""")
def stream_cache(spark, sf):
    """ST6: one-pass cache write as embedding files arrive; full 64-row
    shards with the remainder carried between micro-batches, final partial
    shard flushed at the end.  Shard sizes equal the batch form's."""
    src = _scratch(spark, "emb-files")
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    emb.write.option("maxRecordsPerFile", 100_000).parquet(src)
    stream = spark.readStream.schema(emb.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = _scratch(spark, "stream-cache")
    q = SC.stream_cache(stream, out, "vec_id", 64, os.path.join(out, "_ckpt"))
    q.awaitTermination()
    SC.flush_cache(spark, out, "vec_id", 64)
    back = spark.read.parquet(os.path.join(out, "shards"))
    return back.groupBy(F.col("shard_id").cast("bigint").alias("shard_id")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))
