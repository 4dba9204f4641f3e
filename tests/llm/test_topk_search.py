"""Exact top-k search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import topk_search


def brute(rows, every=50, k=5):
    """Sorted (query_id, rank, score) and the allowed vec_ids of each score."""
    sound = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, [min(max(math.floor(256.0 * x), -2 ** 63), 2 ** 63 - 1024) for x in v]))
    out = []
    for n, (i, q) in enumerate(sound):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, c)), j) for m, (j, c) in enumerate(sound) if m != n)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, partitions=3, **options):
    docs = spark.createDataFrame([(i, v, 7, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, place long, first string").repartition(partitions)
    return sorted(tuple(r) for r in topk_search.search(docs, F.col("vec_id") % 50 == 0, **options).collect())


def vectors(seed, n, width=8, sparse=0.0):
    rng = random.Random(seed)
    return [(i, [0.0 if rng.random() < sparse else rng.randrange(-256, 257) / 256 for _ in range(width)])
            for i in range(n)]


@pytest.mark.parametrize("sparse, block, packet", [
    (0.0, topk_search.BLOCK_ROWS, topk_search.PACKET_ROWS), (0.7, 17, 2), (0.95, 1000, 3)])
def test_equals_brute_force(spark, sparse, block, packet):
    rows = vectors(int(10 * sparse), 400, sparse=sparse)
    got = found(spark, rows, block=(block, 1 << 20), packet=(packet, 1 << 20))
    assert got == brute(rows)


def test_bounds_on_terms(spark):
    rows = vectors(5, 120, width=30)
    assert found(spark, rows, block=(1 << 16, 65), packet=(512, 31)) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, []), (100, [0.0, 0.0, 0.0]), (150, None), (200, [1.0, None]), (250, [math.nan, 1.0]),
            (300, [math.inf]), (None, [9.0, 9.0]), (-50, [-1.0, 0.5]), (7, [3.0, 1.0, 5.0]), (8, [3.0, 1.0]),
            (9, [3.0, 1.0]), (10, [0.001, -0.001])]
    assert found(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.25]) for i in range(300)] + [(50, [0.5, 0.25]), (50, [1.0, 0.0]), (3, [0.5, 0.25])]
    assert found(spark, rows, block=(40, 1 << 20)) == brute(rows)


def test_large_components(spark):
    rows = [(0, [300.0, -2.0]), (1, [4.0e6, 1.0]), (2, [-3.0e6, 1.0]), (50, [1.0e6, 2.0]), (3, [0.5, 0.5])]
    assert found(spark, rows) == brute(rows)


def test_few_or_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (2, [1.0])]) == [(50, 1, 2, 65536)]
