"""Encoder runs and patch rows of the cache; streams out of order, resumed,
and with unreadable state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.features import erf
from tessera.sources import feature_cache as FC
from tessera.streaming import corpus as SC
from tessera.streaming import logs as SL


def test_encoder_runs_once_per_row(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def encode(pdf):
            seen.add(len(pdf))
            return [np.full((3, 2), v, np.float32) for v in pdf["x"]]
        return encode

    df = spark.range(0, 100).select(F.concat(F.lit("id-"), "id").alias("id"), F.col("id").cast("float").alias("x"))
    meta = FC.encode_feature_cache(df, f"{scratch}/c", ["id"], make, shard_size=16)
    assert seen.value == 100
    assert meta.count() == 100 and {r.num_patches for r in meta.collect()} == {3}
    back = spark.read.parquet(f"{scratch}/c/features")
    assert back.count() == 300
    assert sorted(r["count"] for r in meta.groupBy("shard_id").count().collect()) == [4] + [16] * 6


def test_patch_rows_are_written_once(spark, scratch):
    rows = [(i, k, [float(i), float(k)]) for i in range(40) for k in range(4)]
    df = spark.createDataFrame(rows, "id long, patch_idx int, feature array<float>")
    meta = FC.write_feature_cache(df, f"{scratch}/p", ["id"], shard_size=16)
    back = spark.read.parquet(f"{scratch}/p/features")
    assert back.count() == 160 and meta.count() == 40
    assert meta.groupBy("shard_id").count().agg(F.max("count")).first()[0] == 16
    _, feats, _ = FC.scan_feature_cache(spark, _with_manifest(meta, f"{scratch}/p"))
    assert set(feats.columns) == {"shard_id", "pos", "patch_idx", "feature"}


def _with_manifest(meta, root):
    FC.write_manifest(FC.build_manifest(meta, "d", "c", shard_size=16), root)
    return root


def test_erf_is_vectorised_and_exact():
    import math
    x = np.linspace(-7, 7, 5001)
    assert np.abs(erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-9


def test_best_of_files_out_of_order(spark, scratch):
    """Files arrive (1000, 1500), then (500), then (2000 without loss, 2500)."""
    lines = [(1, 1000, 2.0), (1, 1500, 3.0), (2, 500, 4.0), (3, 2000, None), (3, 2500, 1.0)]
    src = f"{scratch}/log"
    for n in (1, 2, 3):
        part = [("a", s, v) for k, s, v in lines if k == n]
        spark.createDataFrame(part, "stage string, step long, loss double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("stage string, step long, loss double").option("maxFilesPerTrigger", 1).parquet(src)
    q = SL.stream_best(stream, 500).writeStream.format("parquet").option("path", f"{scratch}/out") \
        .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.step, r.loss, r.prev_best, r.is_new_best) for r in spark.read.parquet(f"{scratch}/out").orderBy("step").collect()]
    inf = float("inf")
    assert got == [(500, 4.0, inf, True), (1000, 2.0, 4.0, True), (1500, 3.0, 2.0, False), (2500, 1.0, 2.0, True)]


def _cache_run(spark, scratch, rows):
    src = f"{scratch}/src"
    spark.createDataFrame([(i, [float(i)]) for i in rows], "vec_id long, embedding array<double>") \
        .coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("vec_id long, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(src)
    SC.stream_cache(stream, f"{scratch}/cache", "vec_id", 8, f"{scratch}/ckpt").awaitTermination()


def test_cache_stream_resumes_after_a_flush(spark, scratch):
    root = f"{scratch}/cache"
    SC.flush_cache(spark, root, "vec_id", 8)  # nothing was written yet
    _cache_run(spark, scratch, range(0, 20))
    SC.flush_cache(spark, root, "vec_id", 8)
    SC.flush_cache(spark, root, "vec_id", 8)
    assert FC.read_manifest(spark, root).first()["total_samples"] == 20
    _cache_run(spark, scratch, range(20, 31))
    SC.flush_cache(spark, root, "vec_id", 8)
    back = spark.read.parquet(f"{root}/shards")
    assert sorted(r.vec_id for r in back.collect()) == list(range(31))
    sizes = {r.shard_id: r["count"] for r in back.groupBy("shard_id").count().collect()}
    assert sizes == {0: 8, 1: 8, 2: 4, 3: 8, 4: 3}
    man = FC.read_manifest(spark, root).first()
    assert (man["total_samples"], man["num_shards"]) == (31, 5)


def test_unreadable_state_fails(spark, scratch):
    with pytest.raises(Exception):
        SC._read_state(spark, f"{scratch}/nowhere", 3)
    assert SC._read_state(spark, f"{scratch}/nowhere", -1) == (0, 0, None)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tessera import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session)
