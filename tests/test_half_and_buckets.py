"""Half-precision features, and the cache join without a shuffle."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.features import pack_half, unpack_half
from tessera.operators.joins import join_features
from tessera.plans import cache
from tessera.sources import feature_cache as FC

from tests.conftest import SF001


def test_half_equals_numpy(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.standard_normal(i % 9).astype(np.float32) * 10.0 ** rnd.integers(-8, 4)) for i in range(200)]
    rows += [(200, np.array([0.0, -0.0, 65504, 1e9, -1e9, 2.0 ** -24, 2.0 ** -25, np.nan], np.float32))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + [(201, None)], "id long, f array<float>")
    packed = pack_half(df.repartition(3), "f")
    assert packed.schema["f"].dataType.simpleString() == "binary"
    raw = {r.id: r.f for r in packed.collect()}
    with np.errstate(over="ignore"):
        assert all(bytes(raw[i]) == v.astype("<f2").tobytes() for i, v in rows) and raw[201] is None
        back = {r.id: r.f for r in unpack_half(packed, "f").collect()}
        assert back[201] is None
        assert all(np.array_equal(np.array(back[i], np.float32), v.astype(np.float16).astype(np.float32), equal_nan=True)
                   for i, v in rows)


def test_cache_join_has_no_exchange(spark):
    meta, feats, _ = FC.scan_feature_cache(spark, cache.cache_folder(spark, SF001))
    plan = join_features(meta, feats)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert feats.schema["feature"].dataType.simpleString() == "binary"


def test_shards_are_spread_and_tables_registered_again(spark, scratch):
    rows = spark.range(400).select(F.col("id"), F.array(F.col("id").cast("float")).alias("feature"))
    meta = FC.write_feature_cache(rows, f"{scratch}/c", ["id"], shard_size=100)
    FC.write_manifest(FC.build_manifest(meta, "d", "c", shard_size=100), f"{scratch}/c")
    files = spark.read.parquet(f"{scratch}/c/features").select("shard_id", F.input_file_name().alias("file")).distinct()
    assert files.where("shard_id = 0").count() > 4
    for part in ("features", "meta"):  # a later session knows the folder only
        spark.sql(f"drop table {FC._table(f'{scratch}/c', part)}")
    meta, feats, missing = FC.scan_feature_cache(spark, f"{scratch}/c")
    joined = join_features(meta, feats)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("id = cast(feature[0] as long)").count() == 400 and missing.count() == 0
