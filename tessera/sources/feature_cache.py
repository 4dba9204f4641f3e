"""Sharded feature cache: sink (S4), manifest (S5) and scan (S3).

Layout under ``root``:
  features/…parquet   wide: shard_id, pos, feature (with patch_idx, a row per
                      patch), and the narrow columns
  meta/…parquet       narrow: shard_id, pos, id, num_patches, …
  manifest/…json      one row, with the number of buckets

Both tables are bucketed by (shard_id, pos) into equally many buckets, each
written by one task as one file.  So the read-side join (J1) meets rows where
they lie, without a shuffle, and a shard is spread over many tasks and files:
none holds a whole shard of wide rows.  Wide features live apart from narrow
metadata, so metadata-only reads never touch them.  Features are ARRAY<FLOAT>,
or half precision packed into BINARY, two bytes a value.

Bucketing is known to the session's catalog; ``registered`` puts a table that
another session wrote into it again.  Writes go to a folder the caller names; on
a cluster that is a shared folder (``spark.checkpoint.dir`` or a table
location), never a local temp.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators.features import extract_features, pack_half
from tessera.operators.ranking import assign_shards


def shard_map(df: DataFrame, id_col: str, order_cols, shard_size: int,
              rows_per_bucket: int | None = None) -> DataFrame:
    """(_sid, shard_id, pos) of each distinct id of ``df``: shards count
    samples, whatever number of rows a sample has."""
    names = dict.fromkeys([id_col, *order_cols])
    ids = assign_shards(df.select(*names).distinct(), order_cols, shard_size, rows_per_bucket=rows_per_bucket)
    return ids.select(F.col(id_col).alias("_sid"), "shard_id", "pos")


PLACE = ("shard_id", "pos")


def _table(root: str, part: str) -> str:
    return f"tessera_{part}_{hashlib.sha256(root.encode()).hexdigest()[:24]}"


def _write_bucketed(df: DataFrame, root: str, part: str, buckets: int) -> DataFrame:
    """``df``, whose rows a task has of one bucket each, as a bucketed table."""
    name, path = _table(root, part), os.path.join(root, part)
    df.sparkSession.sql(f"drop table if exists {name}")
    df.write.mode("overwrite").bucketBy(buckets, *PLACE).sortBy(*PLACE).option("path", path).format("parquet") \
        .saveAsTable(name)
    return df.sparkSession.table(name)


def registered(spark: SparkSession, root: str, part: str) -> DataFrame:
    """The table ``part`` (features or meta) of the cache at ``root``, with its
    buckets, whichever session wrote it."""
    name, path = _table(root, part), os.path.join(root, part)
    if not spark.catalog.tableExists(name):
        buckets = read_manifest(spark, root).first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        place = ", ".join(PLACE)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({place}) sorted by ({place}) "
                  f"into {buckets} buckets location '{path}'")
    return spark.table(name)


def write_part(df: DataFrame, root: str, part: str) -> DataFrame:
    """``df`` dealt by place and written as the table ``part``."""
    buckets = bucket_count(df.sparkSession)
    return _write_bucketed(df.repartition(buckets, *PLACE), root, part, buckets)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _write(sharded: DataFrame, root: str, feature_col: str, patch_col: str, half: bool) -> DataFrame:
    """One evaluation of ``sharded``, dealt by place: the feature files, then
    the metadata from their narrow columns."""
    buckets = bucket_count(sharded.sparkSession)
    if half:
        sharded = pack_half(sharded, feature_col)
    back = _write_bucketed(sharded, root, "features", buckets)
    meta = back.select(*[c for c in sharded.columns if c not in (feature_col, patch_col)]).distinct()
    return write_part(meta, root, "meta")


def write_feature_cache(df: DataFrame, root: str, order_cols, feature_col: str = "feature",
                        shard_size: int = K.DEFAULT_SHARD_SIZE, id_col: str = "id",
                        already_sharded: bool = False, patch_col: str = "patch_idx",
                        rows_per_bucket: int | None = None, half: bool = False) -> DataFrame:
    """Fixed ``shard_size`` samples per shard (the last one partial),
    shard id and position from the global rank (W3) of the distinct ids.

    ``df`` has one row per sample, or one per patch (``patch_col``).  Only ids
    and order columns are ranked; the rows meet their (shard_id, pos) in one
    join on the id, many rows to one, and are dealt by place, so each bucket is
    written by one task (a retried task rewrites the same bucket).  ``half``
    stores features in half precision, two bytes a value.
    ``df`` is evaluated twice, for the ids and for the rows; use
    ``encode_feature_cache`` where an encoder would run.
    Returns the narrow sharded metadata (for the manifest)."""
    if not already_sharded:
        ids = shard_map(df, id_col, order_cols, shard_size, rows_per_bucket)
        df = df.join(ids, df[id_col] == ids["_sid"]).drop("_sid")
    return _write(df.repartition(bucket_count(df.sparkSession), *PLACE), root, feature_col, patch_col, half)


def encode_feature_cache(df: DataFrame, root: str, order_cols, make_encoder, id_col: str = "id",
                         keep: list[str] | None = None, shard_size: int = K.DEFAULT_SHARD_SIZE,
                         rows_per_bucket: int | None = None, half: bool = False) -> DataFrame:
    """G9 + W3 + S4: rank the ids of the encoder's *input*, deal the inputs by
    place, then encode each row once, where its bucket is written, one row per
    patch.  ``keep`` names the input columns that go into the metadata."""
    ids = shard_map(df, id_col, order_cols, shard_size, rows_per_bucket)
    dealt = df.join(ids, df[id_col] == ids["_sid"]).drop("_sid") \
        .repartition(bucket_count(df.sparkSession), *PLACE)
    encoded = extract_features(dealt, make_encoder, per_patch=True,
                               keep=[id_col, *(keep or []), "shard_id", "pos"])
    return _write(encoded, root, "feature", "patch_idx", half)


def build_manifest(meta: DataFrame, dataset: str, config: str, image_size: int = K.TARGET_SIZE,
                   vision_dim: int = K.VISION_DIM, shard_size: int = K.DEFAULT_SHARD_SIZE) -> DataFrame:
    """S5 + A2: totals of the written shards (count, max shard + 1) plus
    the fixed fields, as one row."""
    a = meta.agg(F.count(F.lit(1)).alias("total_samples"),
                 (F.coalesce(F.max("shard_id"), F.lit(-1)) + 1).cast("bigint").alias("num_shards"))
    return a.select(F.lit(dataset).alias("dataset"), F.lit(config).alias("config"), "total_samples",
                    "num_shards", F.lit(image_size).alias("image_size"),
                    F.lit(vision_dim).alias("vision_dim"), F.lit(shard_size).alias("shard_size"),
                    F.lit(bucket_count(meta.sparkSession)).alias("buckets"))


def write_manifest(manifest: DataFrame, root: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(os.path.join(root, "manifest"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(os.path.join(root, "manifest"))


def missing_shards(spark: SparkSession, root: str) -> DataFrame:
    """S3 report: the shards that the manifest lists (``sequence(0, n-1)``) and
    the metadata lacks."""
    expected = read_manifest(spark, root).select(F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("num_shards").cast("bigint") - 1)).alias("shard_id"))
    found = registered(spark, root, "meta").select("shard_id").distinct()
    return expected.join(found, "shard_id", "left_anti")


def scan_feature_cache(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: (meta, features, missing).  Shards listed by the manifest but
    absent on disk are skipped by the reads and *reported* in ``missing``."""
    feats = registered(spark, root, "features")
    feats = feats.select(*[c for c in feats.columns if c in ("shard_id", "pos", "patch_idx", "feature")])
    return registered(spark, root, "meta"), feats, missing_shards(spark, root)
