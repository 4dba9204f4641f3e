"""Connected components by alternating star contractions, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import few, written

MOST_ROUNDS = 50


def _sign(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b): the smallest node
    it is linked to, directly or through others.  Every round joins a node's
    neighbours to the smallest of them; a node of any degree is combined on
    the map side, and its rows are never gathered."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u != v").distinct(), "edges")
    sign = _sign(edges)
    for _ in range(MOST_ROUNDS):
        if not sign[0]:
            break
        edges = few(edges, sign[0])
        # large star: larger neighbours go to the smallest neighbour or the node itself
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(few(small.unionByName(least.withColumnRenamed("m", "v")), sign[0]).distinct(), "edges")
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not converge")
    edges = few(edges, sign[0])
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
