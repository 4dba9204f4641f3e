"""Action parsing: the reference suite's five cases plus long_press and the
edge rules (unanchored search, fixed order, empty type text, bad numbers,
Indic digits)."""

from pyspark.sql import functions as F

from tessera.functions import actions as AC
from tessera.operators.actions import parse_action_df

GOLDEN = [
    ('click(x=0.45, y=0.72)', "click"),
    ('type(text="hello world")', "type"),
    ('scroll(direction="down")', "scroll"),
    ('drag(startX=0.1, startY=0.2, endX=0.5, endY=0.8)', "drag"),
    ('done()', "done"),
    ('long_press(x=0.3, y=0.5)', "long_press"),
]


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    col_rows = df.select("i", AC.parse_action("t").alias("a")).orderBy("i").collect()
    df_rows = parse_action_df(df, "t", "a").orderBy("i").collect()
    assert [r["a"] for r in col_rows] == [r["a"] for r in df_rows]
    return [r["a"] for r in col_rows]


def test_golden_types(spark):
    got = _parse(spark, [t for t, _ in GOLDEN])
    assert [a["action_type"] for a in got] == [k for _, k in GOLDEN]
    click, typ, scroll, drag, done, lp = got
    assert (click["x"], click["y"]) == (0.45, 0.72)
    assert typ["text"] == "hello world" and scroll["direction"] == "down"
    assert (drag["start_x"], drag["start_y"], drag["end_x"], drag["end_y"]) == (0.1, 0.2, 0.5, 0.8)
    assert (lp["x"], lp["y"]) == (0.3, 0.5)


def test_edge_rules(spark):
    got = _parse(spark, [
        "double_click(x=0.1, y=0.2)",          # unanchored: parses as click
        "click(x=-0.1, y=0.2)",                # negative never matches
        'type(text="")',                       # empty text: no match
        "done() then click(x=0.5, y=0.5)",     # fixed order: click wins
        "   click(x=0.5, y=0.25)\n ",     # Unicode strip
        "click(x=०.१, y=0.2)",       # Devanagari digits read as 0.1
        "click(x=1.2.3, y=0.1)",               # float() would raise: null coordinate
        "nothing", None,
    ])
    assert got[0]["action_type"] == "click" and got[0]["x"] == 0.1
    assert got[1] is None and got[2] is None
    assert got[3]["action_type"] == "click"
    assert got[4]["y"] == 0.25
    assert got[5]["x"] == 0.1
    assert got[6]["action_type"] == "click" and got[6]["x"] is None and got[6]["y"] == 0.1
    assert got[7] is None and got[8] is None


def test_parse_all_and_validate(spark):
    df = spark.createDataFrame([("noise\nclick(x=0.5, y=0.5)\ndone()\nclick(x=1.5, y=0.1)",)], "t string")
    r = df.select(AC.parse_actions("t").alias("acts")).first()["acts"]
    assert [a["action_type"] for a in r] == ["click", "done", "click"]
    v = df.select(F.transform(AC.parse_actions("t"), AC.validate_action).alias("v")).first()["v"]
    assert v == [True, True, False]


def test_split_thought_roundtrip(spark):
    from tessera.functions.prompts import thought_action_target
    df = spark.createDataFrame([("look\nhere", " click(x=0.1, y=0.2) "), (None, "done()"), ("", "done()")],
                               "th string, act string")
    t = df.select(thought_action_target("th", "act").alias("t"))
    th, rest = AC.split_thought("t")
    rows = t.select("t", th.alias("th"), rest.alias("a")).collect()
    assert rows[0]["t"] == "<think>look\nhere</think>\nclick(x=0.1, y=0.2)"
    assert (rows[0]["th"], rows[0]["a"]) == ("look\nhere", "click(x=0.1, y=0.2)")
    assert rows[1]["t"] == "done()" and rows[1]["th"] is None and rows[2]["t"] == "done()"


def test_canonical_target_variant(spark):
    from tessera.operators.fields import canonical_target_variant
    js = ['{"x": 0.5, "y": 0.25}', '{"x_norm": 0.123456, "y_norm": 0.00005}', '{"x": 0.3}',
          '{"x": 0.1, "x_norm": 0.9, "y": 0.2}', '[0.45, 0.72, 9]', '[0.3]', '"  done()\\n"', '5']
    df = spark.createDataFrame([(i, j) for i, j in enumerate(js)], "i int, j string")
    got = [r["t"] for r in df.select("i", canonical_target_variant(F.parse_json("j")).alias("t"))
           .orderBy("i").collect()]
    assert got == ["click(x=0.5000, y=0.2500)", "click(x=0.1235, y=0.0001)", "click(x=0.3000, y=0.0000)",
                   "click(x=0.1000, y=0.2000)", "click(x=0.4500, y=0.7200)", "[0.3]", "done()", "5"]
