"""Joins and set operations.

Equi-joins are left to Catalyst/AQE: a side whose runtime size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is broadcast, otherwise a
sort-merge join runs with AQE splitting skewed partitions.  The one theta
join (``startswith``) is rewritten as an equi-join on
generated prefixes, so it never becomes a nested loop.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import col_
from tessera.operators.ranking import prefix_aggregate
from tessera.session import landed


def join_features(meta: DataFrame, feat: DataFrame, keys=("shard_id", "pos")) -> DataFrame:
    """Cached features joined back to their metadata by (shard, position).
    Both cache tables are bucketed by these columns, so a merge join meets them
    bucket by bucket and neither side is shuffled or broadcast."""
    return meta.hint("merge").join(feat, list(keys), "inner")


def placeholder_positions(df: DataFrame, key: str, ids_col: str,
                          image_token_id: int = K.IMAGE_TOKEN_ID) -> DataFrame:
    """Every placeholder position of each sample with its 0-based
    ordinal ``k``: the sample's array of positions is exploded with its
    index, without a shuffle."""
    placed = F.transform(ids_col, lambda t, i: F.when(t == image_token_id, i))
    pos = df.select(F.col(key), F.posexplode(F.filter(placed, lambda p: p.isNotNull())).alias("k", "position"))
    return pos.select(key, "position", F.col("k").cast("bigint").alias("k"))


def align_features(tokens: DataFrame, feat: DataFrame, key: str, ids_col: str,
                   feat_k: str = "k") -> DataFrame:
    """The k-th placeholder of a sample takes the sample's feature row k.
    The alignment stays narrow (key, position, k) and the wide feature
    column is joined last, on (key, k)."""
    pos = placeholder_positions(tokens, key, ids_col)
    return pos.join(feat.withColumnRenamed(feat_k, "k"), [key, "k"], "inner")


def batch_positions(df: DataFrame, key: str, ids_col: str, batch: str, order_cols,
                    image_token_id: int = K.IMAGE_TOKEN_ID) -> DataFrame:
    """W8 over a flattened batch: ``k`` counts the placeholders of all samples
    of a batch, sample after sample in ``order_cols`` order.  A sample's offset
    is a segmented prefix sum over one narrow row per sample; inside a sample
    the ordinal follows from the array."""
    placed = F.transform(ids_col, lambda t, i: F.when(t == image_token_id, i))
    rows = df.withColumn("_places", F.filter(placed, lambda p: p.isNotNull())).withColumn(
        "_n", F.size("_places").cast("bigint"))
    names = dict.fromkeys([batch, *order_cols, key, "_places", "_n"])
    offset = prefix_aggregate(rows.select(*names), "_n", list(order_cols), [batch], "sum", "_offset")
    return offset.select(batch, key, "_offset", F.posexplode("_places").alias("_k", "position")).select(
        batch, key, "position", (F.col("_offset") + F.col("_k")).cast("bigint").alias("k"))


def align_batches(tokens: DataFrame, feat: DataFrame, key: str, ids_col: str, batch: str, order_cols,
                  feat_k: str = "k") -> DataFrame:
    """J2 as a merge of whole batches: the k-th placeholder of a flattened
    batch takes feature row k of the batch, whose rows are those of all its
    samples, one after the other.  A batch whose placeholders and features
    differ in number is an error that names it, never a shifted merge.  The
    alignment stays narrow; the wide feature column is joined last."""
    pos = landed(batch_positions(tokens, key, ids_col, batch, order_cols), "positions")
    feat = feat.withColumnRenamed(feat_k, "k")
    n_tokens = pos.groupBy(batch).agg(F.count(F.lit(1)).alias("n_tokens"))
    n_feats = feat.groupBy(batch).agg(F.count(F.lit(1)).alias("n_features"))
    bad = n_tokens.join(n_feats, batch, "full").na.fill(0, ["n_tokens", "n_features"]).where("n_tokens <> n_features")
    first = bad.orderBy(batch).first()
    if first is not None:
        raise ValueError(f"batch {first[batch]}: {first['n_tokens']} placeholders, {first['n_features']} features")
    return pos.join(feat, [batch, "k"], "inner")


def resolve_against(df: DataFrame, assets: DataFrame, ref_col: str, asset_key: str,
                    how: str = "inner") -> DataFrame:
    """Samples joined to an asset table; unresolved rows are dropped
    (``inner``) or listed (``left_anti``)."""
    a = assets.withColumnRenamed(asset_key, "_asset_key")
    j = df.join(a, col_(ref_col) == F.col("_asset_key"), how)
    return j.drop("_asset_key") if how not in ("left_anti", "left_semi") else j


def distinct_prefixes(df: DataFrame, name_col: str, depth: int = 3, sep: str = ".") -> DataFrame:
    """The set of first-``depth`` dotted segments of the names."""
    p = F.array_join(F.slice(F.split(col_(name_col), re.escape(sep)), 1, depth), sep)
    return df.select(p.alias("prefix")).distinct()


def prefix_join(names: DataFrame, prefixes: DataFrame, name_col: str = "name",
                prefix_col: str = "prefix") -> DataFrame:
    """``name.startswith(prefix)`` as an equi-join.  Each name is
    expanded to its prefixes of the lengths that occur in the prefix table
    (a handful of distinct lengths, collected as one small list), then
    joined on equality.  Exact; work grows with names x distinct lengths,
    never names x prefixes."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix_col)).distinct().collect() if r[0]]
    if not lengths:
        return names.join(prefixes, F.lit(False), "inner")
    ls = F.array(*[F.lit(int(n)) for n in sorted(lengths)])
    exp = names.select("*", F.explode(ls).alias("_len")) \
        .where(F.length(name_col) >= F.col("_len")) \
        .withColumn("_cand", F.substring(F.col(name_col), F.lit(1), F.col("_len")))
    p = prefixes.withColumnRenamed(prefix_col, "_cand")
    return exp.join(p, "_cand", "inner").withColumnRenamed("_cand", prefix_col).drop("_len")


def reconcile(expected: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    """One full outer join of the distinct keys with a status column:
    ``missing`` (expected only), ``unexpected`` (actual only), ``ok``."""
    e = expected.select(F.col(key).alias("_e")).distinct()
    a = actual.select(F.col(key).alias("_a")).distinct()
    j = e.join(a, e["_e"] == a["_a"], "full_outer")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("ok")
    return j.select(F.coalesce("_e", "_a").alias(key), status.alias("status"))


def compare_runs(df: DataFrame, key: str, run_col: str, value_col: str, runs: list[str]) -> DataFrame:
    """One row per prompt with one column per run.  The run list is
    given, so the pivot needs no extra pass to find its values.  A run that
    repeats a prompt counts with its greatest value, whatever order rows are
    in."""
    p = df.groupBy(key).pivot(run_col, runs).agg(F.max(value_col))
    return p.select(key, *[F.col(f"`{r}`").alias(f"{value_col}_{r}") for r in runs])
