"""Streams equal their batch forms (availableNow / processAllAvailable)."""

import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import trainlog as TL
from tessera.plans import fixtures as FX, streams
from tessera.plans.logs import write_step_logs
from tessera.sources.steplog import scan_step_log
from tessera.streaming import corpus as SC
from tessera.streaming import logs as SL

from tests.conftest import SF001


def _run_memory(df, name, mode, ckpt):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode) \
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_latest_and_best(spark, scratch):
    root = write_step_logs(spark, SF001)
    batch = scan_step_log(spark, root)
    stream = SL.read_step_log_stream(spark, root, max_files_per_trigger=2)
    n = f"latest_{uuid.uuid4().hex[:8]}"
    got = _run_memory(SL.stream_latest(stream), n, "complete", os.path.join(scratch, "c1"))
    want = TL.latest_step(batch)
    assert sorted((r["stage"], r["latest_step"]) for r in got.collect()) == \
        sorted((r["stage"], r["latest_step"]) for r in want.collect())
    n2 = f"best_{uuid.uuid4().hex[:8]}"
    got2 = _run_memory(SL.stream_best(SL.read_step_log_stream(spark, root), 50), n2, "append",
                       os.path.join(scratch, "c2"))
    want2 = TL.running_best(batch, 50).select("stage", "step", "loss", "prev_best", "is_new_best")
    assert got2.exceptAll(want2).count() == 0 and want2.exceptAll(got2).count() == 0


def test_stream_best_of_logs_with_a_gap(spark, scratch, monkeypatch):
    """One stage lacks a save point, one starts after the first, one is whole."""
    every = streams.SAVE_EVERY
    steps = {"gap": [1, 2, 4, 5], "late": [3, 4], "whole": [1, 2]}
    for stage, ks in steps.items():
        os.makedirs(f"{scratch}/log/stage={stage}")
        for k in ks:
            with open(f"{scratch}/log/stage={stage}/{k}.log", "w") as f:
                f.write(f"Step {k * every} | Loss: {6 - k}.5 | LR: 1e-4 | 1.0m\n")
    monkeypatch.setattr(streams, "step_log_folder", lambda spark, sf: f"{scratch}/log")
    got = sorted((r.stage, r.step, r.loss, r.prev_best, r.is_new_best) for r in streams.stream_best(spark, SF001).collect())
    want = []
    for stage, ks in steps.items():
        for before, k in zip([None, *ks], ks):
            want.append((stage, k * every, 6.5 - k, 6.5 - before if before else float("inf"), True))
    assert got == sorted(want)


def test_stream_trigger_fires_once(spark, scratch):
    root = write_step_logs(spark, SF001)
    fired = []
    q = SL.stream_trigger(SL.read_step_log_stream(spark, root, max_files_per_trigger=1), 100,
                          lambda df, bid: fired.extend(r["stage"] for r in df.collect()),
                          os.path.join(scratch, "c"), {"availableNow": True})
    q.awaitTermination()
    stages = [r["stage"] for r in scan_step_log(spark, root).where("step >= 100").select("stage").distinct().collect()]
    assert sorted(fired) == sorted(stages)


def test_stream_accum_equals_batch(spark, scratch):
    micro = FX.microsteps(spark, SF001)
    src = os.path.join(scratch, "micro")
    micro.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(micro.schema).option("maxFilesPerTrigger", 1).parquet(src)
    n = f"accum_{uuid.uuid4().hex[:8]}"
    got = _run_memory(SL.stream_accum(stream, 8), n, "append", os.path.join(scratch, "c"))
    want = TL.accum_loss(micro, 8)
    g = sorted((r["stage"], r["step"], round(r["loss"], 9), r["n"]) for r in got.collect())
    w = sorted((r["stage"], r["step"], round(r["loss"], 9), r["n"]) for r in want.collect())
    assert g == w and len(g) > 0


def test_build_samples_stream_equals_batch(spark, scratch):
    arr = SC.to_array_form(FX.vl_conv(spark, SF001))
    src = os.path.join(scratch, "conv")
    arr.repartition(3).write.parquet(src)
    batch = SC.build_samples(spark.read.parquet(src))
    stream = spark.readStream.schema(arr.schema).option("maxFilesPerTrigger", 1).parquet(src)
    n = f"samples_{uuid.uuid4().hex[:8]}"
    got = _run_memory(SC.build_samples(stream), n, "append", os.path.join(scratch, "c"))
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


def test_stream_cache_shards(spark, scratch):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding")
    src = os.path.join(scratch, "emb")
    emb.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(emb.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(scratch, "cache")
    q = SC.stream_cache(stream, out, "vec_id", 64, os.path.join(scratch, "c"))
    q.awaitTermination()
    SC.flush_cache(spark, out, "vec_id", 64)
    back = spark.read.parquet(os.path.join(out, "shards"))
    n = emb.count()
    assert back.count() == n and back.select("vec_id").distinct().count() == n
    sizes = sorted((r["shard_id"], r["count"]) for r in back.groupBy("shard_id").count().collect())
    assert [s for s, _ in sizes] == list(range(len(sizes)))          # ids 0..k-1, each once
    assert all(c == 64 for _, c in sizes[:-1]) and 0 < sizes[-1][1] <= 64
