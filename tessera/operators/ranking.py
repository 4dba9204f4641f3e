"""Ranks, caps and shard ids without a single-task window.

``row_number() over (order by k)`` without a partition puts the whole table in
one task, and ``partition by key`` does the same for a key that holds a third
of the rows.  ``global_rank`` computes the identical number in three steps:

1. rows are range-partitioned on (partition columns, order columns), sorted,
   numbered in place and written to the shared folder.  The range boundaries
   are Spark's own, sampled from the data on the whole composite key: they
   work for any orderable type, and a value of the first column that a third
   of the rows share is cut by the columns after it;
2. rows per (key, range) are counted (map-side partial aggregation, one small
   row each), and a running sum over that *small* table gives each range's
   offset in its key;
3. the offset is joined back (AQE broadcasts it when its runtime size is under
   the threshold, else it is a shuffle join) and added to the place.

No window ever sees more than the small table.  Writing in step 1 makes the
ranges the same for both uses and for retried tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.selection import first_candidates
from tessera.session import landed


def _order_exprs(order_cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def _placed(df: DataFrame, keys: list[str], order: list[Column], rows_per_bucket: int | None) -> DataFrame:
    """``df`` with the range ``_b`` of each row, non-decreasing in (keys,
    order), and its place ``_i``, consecutive within a range.  There are as
    many ranges as shuffle partitions, or more if ``rows_per_bucket`` asks
    for it."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows_per_bucket:
        buckets = max(buckets, math.ceil(df.count() / rows_per_bucket))
    by = [F.col(c) for c in keys] + order
    placed = df.repartitionByRange(buckets, *by).sortWithinPartitions(*by).withColumn(
        "_i", F.monotonically_increasing_id())
    return landed(placed.withColumn("_b", F.shiftright("_i", 33)), "ranked")


def _join_back(placed: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``placed`` with what ``small`` has per (keys, _b); its keys are named _k_<key> and _kb."""
    cond = [placed["_b"] == small["_kb"]] + [placed[c].eqNullSafe(small[f"_k_{c}"]) for c in keys]
    return placed.join(small, reduce(lambda a, b: a & b, cond), how).drop("_kb", *[f"_k_{c}" for c in keys])


def global_rank(df: DataFrame, order_cols, partition_cols=(), rows_per_bucket: int | None = None,
                rank_col: str = "rank", at_most: int | None = None) -> DataFrame:
    """``row_number() over (partition by partition_cols order by order_cols)``.

    The order columns should be unique within a partition: with ties the
    order among them is arbitrary, though the same for all readers of this
    result.  ``at_most`` keeps the first rows only; ranges wholly beyond them
    are dropped before the join.
    """
    keys, order = list(partition_cols), _order_exprs(order_cols)
    placed = _placed(df, keys, order, rows_per_bucket)
    counts = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_b").alias("_kb"), "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if at_most is not None:
        offsets = offsets.where(F.col("_off") < at_most)
    ranked = _join_back(placed, offsets, keys).withColumn(
        rank_col, (F.col("_off") + F.col("_i") - F.col("_first") + 1).cast("bigint")).drop("_b", "_i", "_off", "_first")
    return ranked if at_most is None else ranked.where(F.col(rank_col) <= at_most)


def cap_per_key(df: DataFrame, key: str, n: int, order_cols, rows_per_bucket: int | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order_cols`` order (W1).  Caps count
    emitted rows, so apply filters first.  If a named column leads the order,
    rows beyond a cutoff from its histograms are left out where they are
    scanned, and only about twice ``n`` per key are ranked."""
    if order_cols and isinstance(order_cols[0], str):
        df = first_candidates(df, [key], n, order_cols[0])
    return global_rank(df, order_cols, [key], rows_per_bucket, "_cap_rank", at_most=n).drop("_cap_rank")


def cap_total(df: DataFrame, n: int, order_cols) -> DataFrame:
    """Global cap; 0 means no limit (W2).  ``orderBy().limit()`` plans as a
    TakeOrderedAndProject: a per-partition top-n, then one merge of n rows."""
    if not n:
        return df
    return df.orderBy(*_order_exprs(order_cols)).limit(n)


def assign_shards(df: DataFrame, order_cols, shard_size: int, rows_per_bucket: int | None = None) -> DataFrame:
    """Shard id ``floor(rank / shard_size)`` and position in the shard, with a
    0-based rank in ``order_cols`` order (W3)."""
    ranked = global_rank(df, order_cols, [], rows_per_bucket, "_r")
    r0 = F.col("_r") - 1
    return ranked.withColumn("shard_id", F.floor(r0 / shard_size).cast("bigint")) \
        .withColumn("pos", (r0 % shard_size).cast("bigint")).drop("_r")


def default_id(df: DataFrame, id_col: str, order_cols, rows_per_bucket: int | None = None) -> DataFrame:
    """Missing ids become the 0-based source ordinal as a string, counted on
    the unfiltered source (W9)."""
    ranked = global_rank(df, order_cols, [], rows_per_bucket, "_ord")
    return ranked.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"),
                                                (F.col("_ord") - 1).cast("string"))).drop("_ord")


_PREFIX_AGGS = {"min": F.min, "max": F.max, "sum": F.sum}


def prefix_aggregate(df: DataFrame, value_col: str, order_cols, partition_cols=(), agg: str = "min",
                     out: str = "prefix", exclusive: bool = True, rows_per_bucket: int | None = None) -> DataFrame:
    """Running ``agg`` of ``value_col`` over (partition by partition_cols
    order by order_cols), over the preceding rows (``exclusive``) or up to
    the current row, without a per-key window over a hot key: the aggregate
    per range is carried across ranges on that small table, and each range
    finishes with its own window.  Order columns must be unique within a
    partition (ties would make the running value ambiguous)."""
    keys, fn = list(partition_cols), _PREFIX_AGGS[agg]
    placed = _placed(df, keys, _order_exprs(order_cols), rows_per_bucket)
    per_range = placed.groupBy(*keys, "_b").agg(fn(value_col).alias("_bagg"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_b").alias("_kb"),
                             fn("_bagg").over(before).alias("_carry"))
    inner = fn(value_col).over(Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0))
    if agg == "sum":
        combined = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(inner, F.lit(0))
    else:
        combined = (F.least if agg == "min" else F.greatest)(F.col("_carry"), inner)   # least/greatest skip nulls
    return _join_back(placed, carry, keys).withColumn(out, combined).drop("_b", "_i", "_carry")
