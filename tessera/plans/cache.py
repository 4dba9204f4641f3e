"""Feature cache write/read and feature alignment
(S3-S5, A2, W3, W8, W9, J1, J2, G8, G9)."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators import features as FE
from tessera.operators import tokens as TK
from tessera.operators.joins import align_batches, align_features, join_features
from tessera.operators.ranking import assign_shards, default_id
from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.artifacts import shared
from tessera.plans.geometry import _resize_sql
from tessera.plans.registry import query
from tessera.plans.samples import TOKENIZED_SQL, tokenized_samples_df
from tessera.session import checkpoint_dir, landed
from tessera.sources import feature_cache as FC
from tessera.sources.corpus import scan_corpus

SHARD_SIZE = 64
LOST_SHARD = 2


def _cache_root(spark) -> str:
    return os.path.join(checkpoint_dir(spark), f"feature-cache-{uuid.uuid4().hex}")


def cache_folder(spark, sf) -> str:
    """The feature cache of ``sf``, written once per session."""
    return shared(spark, sf, "feature-cache", lambda: build_cache(spark, sf))


def build_cache(spark, sf):
    """Write the embeddings as a half-precision feature cache of 64-row shards
    and return the cache root.  Shards are assigned on the ids alone (narrow
    rank)."""
    emb = scan_corpus(spark, f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("feature"), "label",
        F.lit(1).alias("num_patches"))
    root = _cache_root(spark)
    meta = FC.write_feature_cache(emb, root, ["id"], shard_size=SHARD_SIZE, half=True)
    FC.write_manifest(FC.build_manifest(meta, "embeddings", "default", shard_size=SHARD_SIZE), root)
    return root


def sql_half(x: str) -> str:
    """A double rounded to half precision: eleven bits, ties to even."""
    step = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"case when {x} = 0 then 0.0 else round_even({x} / {step}, 0) * {step} end"


SHARDED_SQL = f"""select (rn - 1) // {SHARD_SIZE} as shard_id, (rn - 1) % {SHARD_SIZE} as pos, id, label, feature
from (select vec_id as id, label, embedding as feature, row_number() over (order by vec_id) as rn from embeddings) q"""


@query("feature_cache", with_fixtures(f"""
select shard_id, pos, id, label, len(feature) as dim, {sql_half("feature[1]::double")} as f0,
  list_sum(list_transform(feature, lambda x: {sql_half("x::double")})) as f_sum, 2 * len(feature) as n_bytes
from sharded""", extra={"sharded": SHARDED_SQL}))
def feature_cache(spark, sf):
    """S4 write in half precision -> S3 scan -> J1 join of the narrow metadata
    with the wide features on (shard_id, pos), bucket by bucket."""
    meta, feats, _ = FC.scan_feature_cache(spark, cache_folder(spark, sf))
    j = join_features(meta.select("shard_id", "pos", "id", "label"), feats)
    j = FE.unpack_half(j.withColumn("n_bytes", F.octet_length("feature").cast("bigint")), "feature")
    total = F.aggregate("feature", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return j.select(F.col("shard_id").cast("bigint").alias("shard_id"), F.col("pos").cast("bigint").alias("pos"),
                    "id", "label", F.size("feature").cast("bigint").alias("dim"),
                    F.get("feature", 0).cast("double").alias("f0"), total.alias("f_sum"), "n_bytes")


@query("cache_manifest", with_fixtures(f"""
select 'embeddings' as dataset, 'default' as config, count(*) as total_samples,
       max(shard_id) + 1 as num_shards, 672 as image_size, 4096 as vision_dim, {SHARD_SIZE} as shard_size
from sharded""", extra={"sharded": SHARDED_SQL}))
def cache_manifest(spark, sf):
    """S5 + A2: the manifest as written, read back."""
    root = cache_folder(spark, sf)
    m = FC.read_manifest(spark, root)
    return m.select("dataset", "config", F.col("total_samples").cast("bigint").alias("total_samples"),
                    F.col("num_shards").cast("bigint").alias("num_shards"),
                    F.col("image_size").cast("int").alias("image_size"),
                    F.col("vision_dim").cast("int").alias("vision_dim"),
                    F.col("shard_size").cast("int").alias("shard_size"))


@query("missing_shards", f"select {LOST_SHARD}::bigint as shard_id from embeddings having count(*) > {LOST_SHARD * SHARD_SIZE}")
def missing_shards(spark, sf):
    """S3 report: shards in the manifest but not on disk.  The cache with the
    lost shard is the written one's manifest and the rest of its metadata."""
    def build():
        whole, root = cache_folder(spark, sf), _cache_root(spark)
        meta = FC.registered(spark, whole, "meta").where(F.col("shard_id") != LOST_SHARD)
        FC.write_part(meta, root, "meta")
        FC.write_manifest(FC.read_manifest(spark, whole), root)
        return root
    missing = FC.missing_shards(spark, shared(spark, sf, "lost-shard", build))
    return missing.select(F.col("shard_id").cast("bigint").alias("shard_id"))


@query("align_features", with_fixtures("""
select p.sample_id, p.position, p.k, e.vec_id
from (select sample_id, position, row_number() over (partition by sample_id order by position) - 1 as k
      from (select sample_id, unnest(string_split(ids, ',')) as tid,
                   generate_subscripts(string_split(ids, ','), 1) - 1 as position from tok) x
      where tid = '8') p
join embeddings e on e.vec_id // 8 = p.sample_id and e.vec_id % 8 = p.k""", extra={"tok": TOKENIZED_SQL}))
def align_features_q(spark, sf):
    """J2 + W8: the k-th placeholder of each tokenised sample takes feature
    row k of that sample (features keyed by (sample_id, k))."""
    toks = tokenized_samples_df(spark, sf).select("sample_id", "input_ids")
    feats = scan_corpus(spark, f"{sf}/embeddings.parquet").select(
        F.floor(F.col("vec_id") / 8).cast("bigint").alias("sample_id"), (F.col("vec_id") % 8).alias("k"),
        "vec_id", F.col("embedding").alias("feature"))
    a = align_features(toks, feats, "sample_id", "input_ids")
    return a.select("sample_id", F.col("position").cast("bigint").alias("position"), "k", "vec_id")


BATCH = 8

BATCHED_SQL = {
    "tok": TOKENIZED_SQL,
    "b": f"""select sample_id, ids, (row_number() over (order by sample_id) - 1) // {BATCH} as batch,
  (row_number() over (order by sample_id) - 1) % {BATCH} as seq from tok""",
    "p": """select batch, sample_id, position, row_number() over (partition by batch order by seq, position) - 1 as k
  from (select batch, seq, sample_id, unnest(string_split(ids, ',')) as tid,
               generate_subscripts(string_split(ids, ','), 1) - 1 as position from b) x where tid = '8'""",
}


@query("align_batches", with_fixtures("""
select p.batch, p.sample_id, p.position, p.k, e.vec_id
from p join embeddings e on e.vec_id = (p.batch * 131 + p.k) % (select count(*) from embeddings)""", extra=BATCHED_SQL))
def align_batches_q(spark, sf):
    """J2 in the flattened form: samples in batches of eight, and per batch
    one list of feature rows for all its images, numbered through."""
    toks = assign_shards(tokenized_samples_df(spark, sf).select("sample_id", "input_ids"), ["sample_id"], BATCH) \
        .withColumnsRenamed({"shard_id": "batch", "pos": "seq"})
    toks = landed(toks, "batches")
    n_images = F.size(F.filter("input_ids", lambda t: t == K.IMAGE_TOKEN_ID)).cast("long")
    rows = toks.groupBy("batch").agg(F.sum(n_images).alias("n")).where("n > 0")
    emb = scan_corpus(spark, f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("feature"))
    total = emb.count()
    feats = rows.select("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")) \
        .withColumn("vec_id", (F.col("batch") * 131 + F.col("k")) % total).join(emb, "vec_id")
    a = align_batches(toks, feats, "sample_id", "input_ids", "batch", ["seq"])
    return a.select("batch", "sample_id", F.col("position").cast("bigint").alias("position"), "k", "vec_id")


@query("default_ids", """
select vec_id, id from (
  select vec_id, label, coalesce(case when vec_id % 7 = 0 then null else cast(vec_id as varchar) end,
                                 cast(row_number() over (order by vec_id) - 1 as varchar)) as id
  from embeddings) q where label <> 3""")
def default_ids(spark, sf):
    """A missing id becomes the source ordinal, counted before filters."""
    e = scan_corpus(spark, f"{sf}/embeddings.parquet").select(
        "vec_id", "label", F.when(F.col("vec_id") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("vec_id").cast("string")).alias("id"))
    return default_id(e, "id", ["vec_id"]).where(F.col("label") != 3).select("vec_id", "id")


def projector_weights(dim: int = 64, hidden: int = 64, seed: int = 7):
    rng = np.random.default_rng(seed)
    w1 = rng.standard_normal((hidden, dim)).astype(np.float32) / np.sqrt(dim)
    b1 = rng.standard_normal(hidden).astype(np.float32) * 0.01
    w2 = rng.standard_normal((hidden, hidden)).astype(np.float32) / np.sqrt(hidden)
    b2 = rng.standard_normal(hidden).astype(np.float32) * 0.01
    return w1, b1, w2, b2


@query("project_embeddings")
def project_embeddings_q(spark, sf):
    """G8 (no SQL oracle: neither engine has erf); checked against numpy in
    the tests."""
    e = scan_corpus(spark, f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return FE.project_embeddings(e, "embedding", *projector_weights())


def linear_encoder(patches: int = 4, seed: int = 11):
    """Test encoder (G9): a fixed linear map of each embedding to
    ``patches`` feature rows."""
    def make():
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((patches, 64, 16)).astype(np.float32) / 8.0

        def enc(pdf):
            return [np.einsum("d,pdk->pk", np.asarray(v, dtype=np.float32), w) for v in pdf["embedding"]]
        return enc
    return make


@query("encoded_cache", with_fixtures(f"""
select shard_id, pos, id, label, 4 as num_patches, k as patch_idx, 16 as dim
from sharded, (select unnest(generate_series(0, 3)) as k) p""", extra={"sharded": SHARDED_SQL}))
def encoded_cache(spark, sf):
    """G9 -> W3 -> S4 -> S5 -> S3 -> J1 end to end: ids ranked, each input
    encoded once where its shard is written, a row per patch."""
    def build():
        emb = scan_corpus(spark, f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", "embedding")
        root = _cache_root(spark)
        meta = FC.encode_feature_cache(emb, root, ["id"], linear_encoder(), keep=["label"], shard_size=SHARD_SIZE,
                                       half=True)
        FC.write_manifest(FC.build_manifest(meta, "embeddings", "encoded", shard_size=SHARD_SIZE), root)
        return root
    meta, feats, _ = FC.scan_feature_cache(spark, shared(spark, sf, "encoded-cache", build))
    j = join_features(meta.select("shard_id", "pos", "id", "label", "num_patches"), feats)
    return j.select(F.col("shard_id").cast("bigint").alias("shard_id"), F.col("pos").cast("bigint").alias("pos"), "id",
                    "label", "num_patches", "patch_idx", (F.octet_length("feature") / 2).cast("int").alias("dim"))


def exact_encoder(patches: int = 4, dim: int = 16):
    """An encoder (G9) whose weights and sums SQL can compute too: multiples of
    1/64, added in double precision."""
    def make():
        p, d, k = np.meshgrid(np.arange(patches), np.arange(64), np.arange(dim), indexing="ij")
        w = ((7 * p + 3 * d + 5 * k) % 11 - 5) / 64.0

        def enc(pdf):
            return [np.einsum("d,pdk->pk", np.asarray(v, dtype=np.float64), w) for v in pdf["embedding"]]
        return enc
    return make


@query("encoded_values", f"""
select vec_id, p as patch_idx, {sql_half("v0")} as v0, {sql_half("v5")} as v5
from (select vec_id, p,
        list_sum(list_transform(embedding, lambda x, i: x::double * ((7 * p + 3 * (i - 1)) % 11 - 5) / 64)) as v0,
        list_sum(list_transform(embedding, lambda x, i: x::double * ((7 * p + 3 * (i - 1) + 25) % 11 - 5) / 64)) as v5
      from embeddings, (select unnest(generate_series(0, 3)) as p) q) e""")
def encoded_values(spark, sf):
    """G9 by value: the encoder's half-precision features of each patch."""
    e = scan_corpus(spark, f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    f = FE.extract_features(e, exact_encoder(), per_patch=True, keep=["vec_id"])
    return f.select("vec_id", F.col("patch_idx").cast("bigint").alias("patch_idx"),
                    F.get("feature", 0).cast("double").alias("v0"), F.get("feature", 5).cast("double").alias("v5"))


@query("extract_features")
def extract_features_q(spark, sf):
    """The encoder over Arrow batches, one row per patch (the cache's row
    shape)."""
    e = scan_corpus(spark, f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return FE.extract_features(e, linear_encoder(), per_patch=True, keep=["vec_id"]) \
        .select("vec_id", "patch_idx", "num_patches", "feature")


PLUG_IN_SIZE = 224
PLUG_IN_W, PLUG_IN_H = _resize_sql("w", "h", PLUG_IN_SIZE)


def plug_ins():
    """The three plug-ins of a processor: a tokenizer, an image processor and
    an encoder, each with values that SQL can compute too."""
    def tokenizer(texts):
        return [[len(word) for word in t.split()] for t in texts]

    def image_processor():
        def process(pdf):
            return [((sum(image) + np.arange(gh * gw)) % 97).reshape(-1, 1)
                    for image, gh, gw in zip(pdf["image"], pdf["grid_h"], pdf["grid_w"])]
        return process

    def encoder():
        def encode(pdf):
            return [np.array([[np.max(p), len(p) % 1024]]) for p in pdf["pixels"]]
        return encode
    return tokenizer, image_processor, encoder


@query("plugin_samples", with_fixtures(f"""
select image_id, n_patches, (select sum((b + k) % 97) from (select unnest(generate_series(0, n_patches - 1)) as k))::bigint
    as pixel_sum, case when n_patches >= 97 - b % 97 then 96 else (b + n_patches - 1) % 97 end::double as f_max,
  (n_patches % 1024)::double as f_count,
  concat_ws(',', 5, length(image_id::varchar), 2, length(w::varchar)) as ids
from (select image_id, w, ({PLUG_IN_H} // 16) * ({PLUG_IN_W} // 16) as n_patches,
        list_sum(list_transform(string_split('img_' || image_id, ''), lambda c: ascii(c))) as b from img_dims) p""", "img_dims"))
def plugin_samples(spark, sf):
    """Tokenizer, image processor (on the G1-G3 plan) and encoder (G9) of
    a caller's own, one after the other."""
    tokenizer, image_processor, encoder = plug_ins()
    d = FX.img_dims(spark, sf).withColumn("image", F.concat(F.lit("img_"), F.col("image_id").cast("string")).cast("binary"))
    caption = F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(" at "), F.col("w").cast("string"))
    d = TK.tokenize_with(d.withColumn("caption", caption), "caption", tokenizer, "ids")
    p = FE.process_images(d, image_processor, target=PLUG_IN_SIZE, keep=["image_id", "ids"])
    f = FE.extract_features(p, encoder, per_patch=True, keep=["image_id", "ids", "pixels"])
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("bigint")
    return f.select("image_id", F.size("pixels").cast("bigint").alias("n_patches"), total.alias("pixel_sum"),
                    F.get("feature", 0).cast("double").alias("f_max"), F.get("feature", 1).cast("double").alias("f_count"),
                    F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
