"""Two-phase rank and prefix aggregate against plain windows; prefix join
against brute force; reconcile statuses; caps and shards."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.joins import prefix_join, reconcile
from tessera.operators.ranking import _placed, assign_shards, cap_per_key, default_id, global_rank, prefix_aggregate

from tests.conftest import SF01


def _events(spark):
    return spark.read.parquet(f"{SF01}/events.parquet")


def test_global_rank_multi_bucket_equals_window(spark):
    e = _events(spark).select("event_id", "event_type", "user_id", "ts")
    # a hot key: a third of the rows share one user
    e = e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    got = global_rank(e, ["ts", "event_id"], ["user_id"], rows_per_bucket=97, rank_col="r")
    want = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    assert got.select("event_id", "r").exceptAll(want.select("event_id", "r")).count() == 0
    assert got.count() == want.count()


def test_global_rank_exact_buckets(spark):
    df = spark.createDataFrame([(t, c) for t, c in [("b", 3), ("a", 3), ("zz", 1), ("za", 1), ("c", 2)]],
                               "t string, c long")
    r = global_rank(df, [F.col("c").desc(), F.col("t")], [], rank_col="r")
    assert [x["t"] for x in r.orderBy("r").collect()] == ["a", "b", "c", "za", "zz"]


def test_prefix_min_equals_window(spark):
    e = _events(spark).select("event_id", "event_type", "value")
    got = prefix_aggregate(e, "value", ["event_id"], ["event_type"], "min", "pm", exclusive=True,
                           rows_per_bucket=50)
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    want = e.withColumn("pm", F.min("value").over(w))
    assert got.select("event_id", "pm").exceptAll(want.select("event_id", "pm")).count() == 0


def test_cap_and_shards(spark):
    e = _events(spark).select("event_id", "event_type")
    capped = cap_per_key(e, "event_type", 7, ["event_id"], rows_per_bucket=100)
    assert capped.groupBy("event_type").count().where("count != 7").count() == 0
    s = assign_shards(e, ["event_id"], 1000, rows_per_bucket=333)
    sizes = [r["count"] for r in s.groupBy("shard_id").count().orderBy("shard_id").collect()]
    assert sizes == [1000] * 10
    assert s.agg(F.max("pos")).first()[0] == 999


def test_prefix_join_matches_startswith(spark):
    names = spark.createDataFrame([(n,) for n in ["blocks.1.a", "blocks.10.b", "blocks.2.c", "merger.x", "b"]],
                                  "name string")
    pre = spark.createDataFrame([("blocks.1",), ("blocks.2",), ("merger",), ("zzz",)], "prefix string")
    got = sorted((r["name"], r["prefix"]) for r in prefix_join(names, pre).collect())
    want = sorted((n, p) for n in [r[0] for r in names.collect()] for p in [r[0] for r in pre.collect()]
                  if n.startswith(p))
    assert got == want


def test_reconcile(spark):
    e = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    a = spark.createDataFrame([("b",), ("c",)], "name string")
    got = {r["name"]: r["status"] for r in reconcile(e, a).collect()}
    assert got == {"a": "missing", "b": "ok", "c": "unexpected"}


def test_alignment_fail_mode(spark):
    import pytest
    from tessera.operators.gates import check_alignment
    df = spark.createDataFrame([(3, 3), (2, 3)], "n long, want long")
    assert check_alignment(df, "n", "want", "drop").count() == 1
    with pytest.raises(Exception, match="image token count mismatch"):
        check_alignment(df, "n", "want", "fail").collect()


def test_scan_configs_reports_failures(spark, scratch):
    import os
    from tessera.sources.corpus import scan_configs
    ok = spark.createDataFrame([(1, "a")], "id long, x string")
    p = os.path.join(scratch, "cfg_b")
    spark.createDataFrame([(2, 3.0)], "id long, y double").write.parquet(p)
    union, status = scan_configs(spark, {"a": ok, "b": p, "gone": os.path.join(scratch, "nope")})
    st = {r["config"]: r["ok"] for r in status.collect()}
    assert st == {"a": True, "b": True, "gone": False}
    rows = sorted((r["config"], r["id"], r["x"], r["y"]) for r in union.collect())
    assert rows == [("a", 1, "a", None), ("b", 2, None, 3.0)]


def test_resolve_assets_kinds(spark):
    from tessera.sources.corpus import resolve_assets
    df = spark.createDataFrame([("img_1.png",), ("data:image/png;base64,xx",), ("https://h/x.jpg",),
                                (None,), ("not an image",)], "ref string")
    got = [r["asset_url"] for r in resolve_assets(df, "ref", "http://base/").collect()]
    assert got == ["http://base/img_1.png", "data:image/png;base64,xx", "https://h/x.jpg"]


def test_global_rank_clustered_keys(spark):
    """A third of the rows packed into a tiny slice of the key range still
    ranks exactly, and is spread over many buckets."""
    base = spark.range(0, 3000).select((F.col("id") * 1000).alias("k"))
    dense = spark.range(0, 1500).select((F.lit(5_000_000) + F.col("id") / 1000.0).alias("k"))
    df = base.unionByName(dense).withColumn("g", F.lit(1))
    got = global_rank(df, ["k"], ["g"], rows_per_bucket=50, rank_col="r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("k", "r").exceptAll(want.select("k", "r")).count() == 0
    b = _placed(df, ["g"], [F.col("k")], 50)
    biggest = b.groupBy("_b").count().agg(F.max("count")).first()[0]
    assert biggest <= 200          # the 1,500 dense rows are split across buckets


def test_global_rank_splits_tied_first_key(spark):
    """A third of the rows share one timestamp: the tie is split by the
    second order column, and the rank still equals the plain window."""
    e = _events(spark).select("event_id", "ts", "user_id")
    e = e.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
                     .otherwise(F.col("ts")))
    got = global_rank(e, ["ts", "event_id"], [], rows_per_bucket=100, rank_col="r")
    want = e.withColumn("r", F.row_number().over(Window.orderBy("ts", "event_id")))
    assert got.select("event_id", "r").exceptAll(want.select("event_id", "r")).count() == 0
    # the tied third (about 3,300 rows) is not one range
    t = _placed(e, [], [F.col("ts"), F.col("event_id")], 100)
    biggest = t.groupBy("_b").count().agg(F.max("count")).first()[0]
    assert biggest < 400


def test_rank_orders_strings_and_hot_values(spark):
    """Any orderable key: string ids, nulls first, and a value that half a
    per cent, or a third, of the rows share."""
    df = spark.range(0, 4000).select(
        F.col("id"), F.concat(F.lit("id-"), (F.col("id") * 7919 % 4000).cast("string")).alias("name"),
        F.when(F.col("id") % 200 == 0, "hot").when(F.col("id") % 3 == 0, "hotter")
        .when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    for order, keys in ((["name"], []), (["k", "name"], []), (["name"], ["k"])):
        got = global_rank(df, order, keys, rows_per_bucket=50, rank_col="r")
        want = df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        assert got.select("id", "r").exceptAll(want.select("id", "r")).count() == 0
    biggest = _placed(df, [], [F.col("k"), F.col("name")], 50).groupBy("_b").count().agg(F.max("count")).first()[0]
    assert biggest < 250
    shards = assign_shards(df, ["name"], 1000)
    assert [r["count"] for r in shards.groupBy("shard_id").count().orderBy("shard_id").collect()] == [1000] * 4
    capped = cap_per_key(df.where("k is not null"), "k", 5, ["name"])
    assert capped.groupBy("k").count().agg(F.max("count")).first()[0] == 5
    assert default_id(df, "k", ["name"]).where("k is null").count() == 0
    assert global_rank(df.limit(0), ["name"]).count() == 0
