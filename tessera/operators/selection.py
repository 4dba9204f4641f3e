"""Distributed selection: rows that can be among the first n of their key.

A cap needs the first n rows of each key in some order, not the whole order.
``first_candidates`` finds, from histograms of the order column, a cutoff per
key with at least n rows up to it, so that all others fall away where they are
scanned and only the survivors, at most about twice n per key, are ranked,
shuffled and written.

The order column is read as a number that never falls when the column rises
(a string by its first six bytes, so ties only keep more rows).  Each pass
counts the rows of an open key in ``BINS`` bins between two such numbers and
goes on inside the bin that holds the n-th row, which shrinks the range a
thousandfold; rows that share one number stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import landed

BINS = 1 << 10
PASSES = 12
FAR = 1e300
PREFIX_BYTES = 6


def order_number(df: DataFrame, col: str) -> Column | None:
    """The column as a finite double that is non-decreasing in its ascending
    order (nulls first), or None for a type without such a number."""
    t, c = df.schema[col].dataType, F.col(col)
    if isinstance(t, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
        x = F.conv(head, 16, 10).cast("double")
    elif isinstance(t, T.DateType):
        x = F.unix_date(c).cast("double")
    elif isinstance(t, T.BooleanType):
        x = c.cast("int").cast("double")
    elif isinstance(t, (T.NumericType, T.TimestampType)):
        x = c.cast("double")
        x = F.when(F.isnan(x), F.lit(FAR)).otherwise(F.greatest(F.least(x, F.lit(FAR)), F.lit(-FAR)))
    else:
        return None
    return F.when(c.isNull(), F.lit(-FAR)).otherwise(x)  # least and greatest pass over nulls


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def first_candidates(df: DataFrame, keys: list[str], n: int | Column, col: str) -> DataFrame:
    """Rows of ``df`` among which are the first ``n`` of each key (``n`` may
    depend on the key) in any order that ``col`` ascending leads."""
    number = order_number(df, col)
    if number is None:
        return df
    n = F.lit(n) if isinstance(n, int) else n
    small = [F.col(k).alias(f"_k_{k}") for k in keys]
    narrow = df.select(*keys, number.alias("_x"))
    found = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    open_ = landed(found.where(F.col("_n") > 2 * n).select(
        *small, F.lit(0).cast("long").alias("_below"), "_lo", "_hi", n.cast("long").alias("_want")), "open")
    cutoffs = None
    for _ in range(PASSES):
        if open_.isEmpty():
            break
        inside = narrow.join(open_, _on(narrow, open_, keys)).where("_x >= _lo and _x <= _hi")
        # halves, as the distance of two finite numbers may not be one
        place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(BINS - 1), F.floor(
            BINS * (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)))).otherwise(F.lit(0))
        names = [f"_k_{k}" for k in keys]
        bins = inside.groupBy(*names, "_below", "_want", place.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_upto", F.col("_below") + F.sum("_n").over(upto))
        # the bin that holds the n-th row
        at = landed(bins.where("_upto >= _want and _upto - _n < _want"), "bins")
        done = "_upto <= 2 * _want or _lo = _hi"
        closed = at.where(done).select(*names, F.col("_hi").alias("_cut"))
        cutoffs = closed if cutoffs is None else cutoffs.unionByName(closed)
        open_ = at.where(f"not ({done})").select(*names, (F.col("_upto") - F.col("_n")).alias("_below"), "_lo", "_hi", "_want")
    if cutoffs is None:
        return df
    # keys with few rows, or still open, have no cutoff
    rows = df.withColumn("_x", number)
    kept = rows.join(cutoffs, _on(rows, cutoffs, keys), "left").where("_cut is null or _x <= _cut")
    return kept.select(*df.columns)
