"""Weight-catalog analytics (A3-A6, F7-F9, W10; J4/J5/J8 in ``joins``).

A catalog row is one named tensor: ``name, shape, elem_bytes, trainable``.
All reductions are global or per-component group-bys (partial aggregation
per task, a handful of output rows); the prefix rollup is an equi-join on
generated prefixes, never a nested loop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col_
from tessera.operators.joins import distinct_prefixes, prefix_join


def numel(shape) -> Column:
    """Product of the dimensions."""
    return F.aggregate(col_(shape), F.lit(1).cast("bigint"), lambda a, x: a * x.cast("bigint"))


def under_prefix(df: DataFrame, name_col: str, prefix: str, strip: str | None = None,
                 out: str = "clean_name") -> DataFrame:
    """names under ``prefix`` (``startswith`` pushes to the scan as a
    string-prefix filter), with ``strip`` removed from the front."""
    kept = df.where(F.col(name_col).startswith(prefix))
    s = strip if strip is not None else ""
    return kept.withColumn(out, F.regexp_replace(F.col(name_col), "^" + re.escape(s), "") if s else F.col(name_col))


def segments(name_col: str, depth: int, sep: str = ".") -> Column:
    return F.array_join(F.slice(F.split(F.col(name_col), re.escape(sep)), 1, depth), sep)


def size_rollup(df: DataFrame, component: Column, shape: Column, elem_bytes: str = "elem_bytes") -> DataFrame:
    """A3: tensors, parameters and bytes per component, plus the total row
    (``rollup``; the total has a null component, shown as 'ALL')."""
    t = df.select(component.alias("component"), numel(shape).alias("_n"), F.col(elem_bytes).alias("_eb"))
    r = t.rollup("component").agg(F.count(F.lit(1)).alias("n_tensors"), F.sum("_n").alias("params"),
                                  F.sum(F.col("_n") * F.col("_eb")).alias("bytes"))
    return r.select(F.coalesce("component", F.lit("ALL")).alias("component"), "n_tensors", "params", "bytes")


def hierarchy_rollup(df: DataFrame, name_col: str, size: Column, depth: int = 3,
                     mode: str = "exact") -> DataFrame:
    """A4: size by the first ``depth`` dotted segments.  ``exact`` groups by
    the segment prefix; ``prefix`` reproduces ``startswith`` matching, so
    ``blocks.1`` also counts ``blocks.10`` (J8 distinct prefixes + J4)."""
    t = df.select(F.col(name_col).alias("_name"), size.alias("_size"))
    if mode == "exact":
        g = t.groupBy(segments("_name", depth).alias("prefix"))
    elif mode == "prefix":
        pre = distinct_prefixes(t, "_name", depth)
        g = prefix_join(t, pre, "_name", "prefix").groupBy("prefix")
    else:
        raise ValueError(mode)
    return g.agg(F.count(F.lit(1)).alias("n_tensors"), F.sum("_size").alias("params"))


def trainable_stats(df: DataFrame, size: Column, trainable: str = "trainable") -> DataFrame:
    """A5: total and trainable parameters and the trainable share in %."""
    t = df.select(size.alias("_n"), F.col(trainable).alias("_t"))
    a = t.agg(F.sum("_n").alias("total_params"),
              F.coalesce(F.sum(F.when(F.col("_t"), F.col("_n"))), F.lit(0)).cast("bigint").alias("trainable_params"))
    return a.withColumn("trainable_pct", F.round(F.try_divide(F.col("trainable_params") * 100.0,
                                                              F.col("total_params")), 6))


def router_warnings(df: DataFrame, name_col: str, is_router: Column, trainable: str = "trainable") -> DataFrame:
    """A5 warnings: router weights that are trainable."""
    return df.where(is_router & F.col(trainable)).select(
        F.col(name_col), F.concat(F.lit("Router weight "), F.col(name_col),
                                  F.lit(" is trainable! Should be frozen.")).alias("warning"))


def all_frozen(df: DataFrame, is_router: Column, group: Column | None = None,
               trainable: str = "trainable") -> DataFrame:
    """Every router weight frozen (true when there are none)."""
    agg = F.coalesce(F.bool_and(F.when(is_router, ~F.col(trainable))), F.lit(True)).alias("routers_frozen")
    if group is None:
        return df.agg(agg)
    return df.groupBy(group.alias("component")).agg(agg)


def check_required(df: DataFrame, name_col: str, patterns: list[str]) -> DataFrame:
    """F8: for each required pattern, whether some name contains it.  One
    pass computes one ``bool_or`` per pattern; ``stack`` makes rows."""
    aggs = [F.coalesce(F.bool_or(F.contains(F.col(name_col), F.lit(p))), F.lit(False)).alias(f"_p{i}")
            for i, p in enumerate(patterns)]
    a = df.agg(*aggs)
    args = ", ".join(f"'{p}', _p{i}" for i, p in enumerate(patterns))
    return a.selectExpr(f"stack({len(patterns)}, {args}) as (pattern, present)")


_OPS = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t,
        "<=": lambda v, t: v <= t, "==": lambda v, t: v == t}


def check_expectations(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``metrics(metric, value)`` joined to ``rules(metric, op,
    threshold)``; ``passed`` evaluates the operator.  A metric with no
    value fails."""
    j = rules.join(metrics, "metric", "left")
    v, t, op = F.col("value").cast("double"), F.col("threshold").cast("double"), F.col("op")
    passed = F.lit(False)
    for sym, fn in _OPS.items():
        passed = F.when(op == sym, F.coalesce(fn(v, t), F.lit(False))).otherwise(passed)
    return j.select("metric", "value", "op", "threshold", passed.alias("passed"))


def latest_by_name(df: DataFrame, group: Column, name_col: str) -> DataFrame:
    """Lexically greatest name per group (a ``max``, no sort)."""
    return df.groupBy(group.alias("component")).agg(F.max(name_col).alias("latest_name"),
                                                     F.count(F.lit(1)).alias("n_names"))


def listed_names(df: DataFrame, name_col: str, group: Column | None = None) -> DataFrame:
    """Names in lexical order with their place in the listing, per group
    or over all.  A global rank: no task sorts a whole group."""
    from tessera.operators.ranking import global_rank
    names = df.select(*([group.alias("component")] if group is not None else []), F.col(name_col).alias("name")).distinct()
    return global_rank(names, ["name"], ["component"] if group is not None else [], rank_col="place")
