"""Python-exact text rules, geometry and schedule against plain Python."""

import math

from pyspark.sql import functions as F

from tessera.functions import geometry as GE
from tessera.functions.text import py_fixed4, py_strip


def test_py_strip_matches_python(spark):
    vals = ["  a b  ", "　x ", "\x1cy\x85", "\t\n z \r\x0b\x0c", "", "no", "​keep​"]
    rows = spark.createDataFrame([(v,) for v in vals], "s string").select(py_strip("s").alias("s")).collect()
    assert [r["s"] for r in rows] == [v.strip() for v in vals]


def test_fixed4_matches_python(spark):
    vals = [v / 1000 for v in range(0, 5000, 7)] + [0.00005, 0.00015, 2.675, 1e-9]
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select(py_fixed4("x").alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{v:.4f}" for v in vals]


def _py_resize(w, h, target=672, eff=32):
    scale = target / max(w, h)
    return (max(eff, round(w * scale / eff) * eff), max(eff, round(h * scale / eff) * eff))


def test_resize_and_tokens(spark):
    dims = [(672, 672), (336, 336), (100, 50), (1920, 1080), (333, 999), (5000, 31)] + \
           [(320 + i % 900, 240 + i % 700) for i in range(0, 3000, 13)]
    df = spark.createDataFrame(dims, "w long, h long")
    nw, nh = GE.resize_plan("w", "h")
    rows = df.select("w", "h", nw.alias("nw"), nh.alias("nh"),
                     GE.num_image_tokens(nw, nh).alias("n"),
                     GE.num_image_tokens("w", "h").alias("n_raw")).collect()
    for r in rows:
        assert (r["nw"], r["nh"]) == _py_resize(r["w"], r["h"])
        assert r["n"] == (r["nh"] // 16 // 2) * (r["nw"] // 16 // 2)
    by = {(r["w"], r["h"]): r for r in rows}
    assert by[(672, 672)]["n"] == 441          # 672^2 -> 441 image tokens
    assert by[(336, 336)]["n_raw"] == 100      # 336^2 -> 10 x 10 placeholders
    assert by[(100, 50)]["nw"] == 672          # small images are enlarged


def _py_lr(step, warmup, total):
    if step < warmup:
        return step / max(1, warmup)
    progress = (step - warmup) / max(1, total - warmup)
    return max(0.0, 0.5 * (1.0 + math.cos(math.pi * progress)))


def test_lr_schedule(spark):
    df = spark.range(0, 1500, 7).withColumnRenamed("id", "step")
    rows = df.select("step", GE.lr_factor("step", 100, 1000).alias("f")).collect()
    for r in rows:
        assert abs(r["f"] - _py_lr(r["step"], 100, 1000)) < 1e-12
    assert any(r["step"] > 1000 and r["f"] > 0 for r in rows)   # not clamped past the end


def test_rate_guard(spark):
    r = spark.createDataFrame([(10, 0.0), (10, 2.0)], "n long, s double") \
        .select(GE.rate("n", "s").alias("r")).collect()
    assert [x["r"] for x in r] == [0.0, 5.0]


def test_preview_counts_code_points_like_python(spark):
    from tessera.functions.prompts import preview
    vals = ["😀" * 150 + "abc" * 40, "नमस्ते, आप कैसे हैं?" * 20, "இது என்ன?" * 30, "short"]
    rows = spark.createDataFrame([(v,) for v in vals], "s string").select(preview("s").alias("p")).collect()
    assert [r["p"] for r in rows] == [v[:200] for v in vals]
