"""G8 against numpy brute force; G9 shape and fp16 rounding; cache round trip."""

import math

import numpy as np

from tessera.operators.features import extract_features, mlp_project, project_embeddings
from tessera.plans.cache import linear_encoder, projector_weights

from tests.conftest import SF01


def _gelu(x):
    return np.array([[0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in row] for row in x])


def test_projector_matches_numpy(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding")
    w = projector_weights()
    got = {r["vec_id"]: np.array(r["projected"]) for r in project_embeddings(e, "embedding", *w).collect()}
    rows = e.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    w1, b1, w2, b2 = [a.astype(np.float64) for a in w]
    want = _gelu(x @ w1.T + b1) @ w2.T + b2 + x          # residual: dims equal
    for i, r in enumerate(rows):
        assert np.allclose(got[r["vec_id"]], want[i], rtol=1e-4, atol=1e-4)
    assert mlp_project(np.ones((2, 3)), np.ones((4, 3)), np.zeros(4), np.ones((5, 4)), np.zeros(5)).shape == (2, 5)


def test_extract_features_fp16(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").where("label != 3").select("vec_id", "embedding")
    out = extract_features(e, linear_encoder()).collect()
    assert len(out) == e.count()
    enc = linear_encoder()()
    import pandas as pd
    r = out[0]
    src = e.where(f"vec_id = {r['vec_id']}").toPandas()
    want = np.asarray(enc(src)[0], dtype=np.float16).astype(np.float32).reshape(-1)
    assert r["num_patches"] == 4 and np.array_equal(np.array(r["feature"], dtype=np.float32), want)


def test_feature_cache_roundtrip(spark, scratch):
    """S4 (narrow rank + one wide join) -> S3 -> J1 gives back every row."""
    import os
    from pyspark.sql import functions as F
    from tessera.operators.joins import join_features
    from tessera.sources import feature_cache as FC
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("feature"), "label")
    root = os.path.join(scratch, "cache")
    meta = FC.write_feature_cache(emb, root, ["id"], shard_size=64, rows_per_bucket=100)
    FC.write_manifest(FC.build_manifest(meta, "embeddings", "default", shard_size=64), root)
    m, f, missing = FC.scan_feature_cache(spark, root)
    assert missing.count() == 0
    back = join_features(m, f).select("id", "feature", "label")
    assert back.count() == emb.count()
    assert back.exceptAll(emb.select("id", "feature", "label")).count() == 0
    sizes = sorted(r["count"] for r in m.groupBy("shard_id").count().collect())
    assert sizes[-1] == 64 and sum(sizes) == emb.count()
    man = FC.read_manifest(spark, root).first()
    assert man["num_shards"] == len(sizes) and man["total_samples"] == emb.count()


def test_extract_features_per_patch(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").where("label != 3").select("vec_id", "embedding")
    flat = {r["vec_id"]: r["feature"] for r in extract_features(e, linear_encoder()).collect()}
    out = extract_features(e, linear_encoder(), per_patch=True, keep=["vec_id"])
    assert out.columns == ["vec_id", "feature", "num_patches", "patch_idx"]
    rows = out.collect()
    assert len(rows) == 4 * len(flat)
    by = {}
    for r in rows:
        assert r["num_patches"] == 4 and len(r["feature"]) == 16
        by.setdefault(r["vec_id"], {})[r["patch_idx"]] = r["feature"]
    for vid, f in flat.items():
        assert [x for k in range(4) for x in by[vid][k]] == list(f)
