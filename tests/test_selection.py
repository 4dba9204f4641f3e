"""Selection before ranking, two-level dictionaries, whole-batch alignment."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.dictionary import decode, encode
from tessera.operators.joins import align_batches
from tessera.operators.mixture import mix_weighted
from tessera.operators.ranking import cap_per_key
from tessera.operators.selection import first_candidates


def _rows(kind, n, seed=3):
    rnd = random.Random(seed)
    value = {"long": lambda: rnd.randrange(-10 ** 12, 10 ** 12), "tied": lambda: rnd.choice([1, 1, 1, 2, 3]),
             "skewed": lambda: int(2 ** rnd.uniform(0, 60)), "string": lambda: f"id-{rnd.randrange(10 ** 9)}",
             "double": lambda: rnd.choice([float("nan"), float("-inf"), rnd.uniform(-1, 1), 1e308, None]),
             "date": lambda: None if rnd.random() < 0.1 else f"20{rnd.randrange(10, 99)}-01-{rnd.randrange(10, 28)}"}[kind]
    # one key holds two thirds of the rows, one has none to spare, one is null
    return [(rnd.choice(["hot"] * 8 + ["a", "b", None, None]), value(), i) for i in range(n)]


@pytest.mark.parametrize("kind", ["long", "tied", "skewed", "string", "double", "date"])
def test_cap_equals_a_window(spark, kind):
    t = {"string": "string", "double": "double", "date": "string"}.get(kind, "long")
    df = spark.createDataFrame(_rows(kind, 4000), f"k string, x {t}, id long").repartition(5)
    if kind == "date":
        df = df.withColumn("x", F.col("x").cast("date"))
    df.createOrReplaceTempView("sel")
    for n in (3, 60):
        want = {(r.k, r.id) for r in spark.sql(
            f"select k, id from (select *, row_number() over (partition by k order by x, id) rn from sel) where rn <= {n}"
        ).collect()}
        assert {(r.k, r.id) for r in cap_per_key(df, "k", n, ["x", "id"]).collect()} == want


def test_only_about_twice_the_cap_survives(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("x"), "id")
    for n in (30, 5000):
        left = first_candidates(df, ["k"], n, "x").groupBy("k").count().collect()
        assert len(left) == 3 and all(n <= r["count"] <= 2 * n for r in left)


def test_mix_of_a_short_and_an_empty_source(spark):
    big = spark.range(5000).select("id")
    mixed = mix_weighted({"big": (big, 0.5), "short": (big.limit(3), 0.3), "none": (big.limit(0), 0.2)}, 200, "id", 5)
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == {"big": 100, "short": 3}
    assert mixed.columns == ["id", "source"]


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_dictionary_round_trip(spark, most):
    rnd = random.Random(most)
    rows = [(i, [rnd.choice("abcdefgh") for _ in range(rnd.randrange(6))]) for i in range(50)] + [(50, None), (50, ["a", None])]
    df = spark.createDataFrame(rows, "id long, v array<string>").repartition(3)
    coded, entries = encode(df, "v", most)
    per = entries.groupBy("slice").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d")).collect()
    assert per and all(r.n - 1 <= r.d <= r.n for r in per)  # distinct elements, null perhaps among them
    back = decode(coded, entries.select("slice", "number", F.upper("value").alias("u")), "u")
    want = sorted((i, [x and x.upper() for x in v or []]) for i, v in rows)
    assert sorted((r.id, r.u) for r in back.collect()) == want


def _batches(spark, lengths, extra=0):
    """Samples of several batches with so many placeholders, and the features."""
    rows = [(b, s, 100 * b + s, [7] * s + [8] * n + [9, 8][:1 + (n > 2)])
            for b, ns in lengths.items() for s, n in enumerate(ns)]
    total = {b: sum(ids.count(8) for bb, _, _, ids in rows if bb == b) for b in lengths}
    feats = [(b, k, f"{b}-{k}") for b, n in total.items() for k in range(n + (extra if b == 2 else 0))]
    return (rows, spark.createDataFrame(rows, "batch long, seq long, sample long, ids array<int>").repartition(4),
            spark.createDataFrame(feats, "batch long, k long, feature string").repartition(3))


def test_batches_take_features_in_flattened_order(spark):
    rows, toks, feats = _batches(spark, {1: [3, 0, 5], 2: [1], 3: [2, 2, 2, 4]})
    got = {(r.sample, r.position): r.feature for r in
           align_batches(toks, feats, "sample", "ids", "batch", ["seq"]).collect()}
    want, k = {}, {}
    for b, _, sample, ids in sorted(rows):
        for at, t in enumerate(ids):
            if t == 8:
                want[sample, at] = f"{b}-{k.setdefault(b, 0)}"
                k[b] += 1
    assert got == want


@pytest.mark.parametrize("extra", [1, -1])
def test_batch_with_another_number_of_features_fails(spark, extra):
    _, toks, feats = _batches(spark, {1: [3], 2: [4, 1]}, extra)
    with pytest.raises(ValueError, match="batch 2: 6 placeholders, "):
        align_batches(toks, feats, "sample", "ids", "batch", ["seq"])
