"""Derived fixtures: views over the driver tables that give the operators
their input shapes (conversation corpus, grounding and trajectory records,
micro-step losses, step logs, evaluation responses, a weight catalog, a
feature table).  Their SQL twins for the oracle are in ``fixture_sql``.

All fixtures are row-wise projections except the ranked ones, which use the
two-phase ``global_rank`` so that no key (five event types, a hot user) is
ranked inside a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank
from tessera.sources.tables import table

NL = "\n"


def vl_conv(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation corpus in long form: one row per turn."""
    c = table(spark, sf, "conversations")
    role, turn, cid = F.col("role"), F.col("turn"), F.col("conv_id")
    return c.select(
        cid.alias("sample_id"), turn,
        F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role).alias("speaker"),
        F.when((role == "user") & (turn <= 1), F.concat(F.lit("<image>" + NL), F.col("text")))
         .otherwise(F.col("text")).alias("value"),
        F.when(cid % 10 == 9, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("img_"), (cid % 250).cast("string"), F.lit(".png"))).alias("image_ref"),
        (cid % 7 + 1).alias("num_patches"))


def img_dims(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("image_id"),
                    (F.lit(320) + F.col("event_id") % 900).alias("w"),
                    (F.lit(240) + F.col("event_id") % 700).alias("h"))


def gui_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Grounding records: instruction, a target that is a dict (x, y), a
    list, or a string, and a free-text action."""
    e = table(spark, sf, "events")
    eid = F.col("event_id")
    m10 = eid % 10
    target_text = (F.when(m10 == 0, "click(x=0.45, y=0.72)")
                   .when(m10 == 1, 'type(text="hello world")')
                   .when(m10 == 2, 'scroll(direction="down")')
                   .when(m10 == 3, "drag(startX=0.1, startY=0.2, endX=0.5, endY=0.8)")
                   .when(m10 == 4, "long_press(x=0.3, y=0.5)")
                   .when(m10 == 5, "done()")
                   .when(m10 == 6, "double_click(x=0.1, y=0.2)")
                   .when(m10 == 7, "no action here")
                   .when(m10 == 8, "click(x=1.2.3, y=0.1)")
                   .otherwise('type(text="")'))
    return e.select(
        eid.alias("sample_id"),
        F.when(eid % 17 == 0, F.lit(None).cast("string")).when(eid % 19 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("tap the "), F.col("event_type"))).alias("instruction"),
        F.when(eid % 3 == 0, "dict").when(eid % 3 == 1, "list").otherwise("str").alias("kind"),
        (F.col("value") / 500).alias("x"), (F.col("value") / 1000).alias("y"),
        target_text.alias("target_text"))


def gui_steps(spark: SparkSession, sf: str, history_keep: int = 5,
              rows_per_bucket: int | None = None) -> DataFrame:
    """Trajectory steps with the user's previous event types as history.

    P10 reads the last three items of what a step carries; a step carries up
    to ``history_keep``, more than that, so that the operator does the
    cutting.  They are fetched by an equi-join on (user, rank - d) for
    d = 1..keep: it spreads a hot user over all tasks, where a per-user
    window (or a full prefix list, quadratic in the user's rows) would put
    it in one.
    """
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    ranked = global_rank(e, ["ts", "event_id"], ["user_id"], rows_per_bucket, "_rn")
    prev = ranked.select(F.col("user_id").alias("_pu"), F.col("event_type").alias("_pt"),
                         F.explode(F.sequence(F.lit(1), F.lit(history_keep))).alias("_d"),
                         F.col("_rn").alias("_prn")) \
        .select("_pu", "_pt", "_d", (F.col("_prn") + F.col("_d")).alias("_trn"))
    joined = ranked.join(prev, (ranked["user_id"].eqNullSafe(prev["_pu"]))
                         & (ranked["_rn"] == prev["_trn"]), "left")
    hist = joined.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_d").isNotNull(),
                                           F.struct(-F.col("_d"), F.col("_pt"))))).alias("_h"))
    hist = hist.select("event_id", F.transform("_h", lambda s: s["_pt"]).alias("history_list"))
    eid = F.col("event_id")
    m4 = eid % 4
    action = (F.when(m4 == 0, F.lit('scroll(direction="down")' + NL + "done()"))
              .when(m4 == 1, "click(x=0.45, y=0.72)")
              .when(m4 == 2, F.lit("noise" + NL + 'type(text="hello world")'))
              .otherwise("long_press(x=0.3, y=0.5)"))
    base = e.select(eid.alias("sample_id"), "user_id",
                    F.concat(F.lit("do "), F.col("event_type")).alias("instruction"),
                    F.when(eid % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("see "), F.col("event_type"))).alias("thought"),
                    action.alias("action"), eid.alias("_eid"))
    return base.join(hist, base["_eid"] == hist["event_id"], "left") \
        .drop("_eid", "event_id")


def microsteps(spark: SparkSession, sf: str,
               rows_per_bucket: int | None = None) -> DataFrame:
    """Micro-step losses of five stages, 0-based index per stage."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    r = global_rank(e, ["event_id"], ["event_type"], rows_per_bucket=rows_per_bucket, rank_col="_r")
    return r.select(F.col("event_type").alias("stage"), (F.col("_r") - 1).alias("micro_idx"),
                    (F.col("value") / 100).alias("loss"))


def step_log_rows(spark: SparkSession, sf: str,
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Step-log lines per stage; the loss is written from an integer so the
    text needs no float formatting."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    r = global_rank(e, ["event_id"], ["event_type"], rows_per_bucket=rows_per_bucket, rank_col="_r")
    c = F.round(F.col("value") * 100).cast("bigint")
    q = r.select(F.col("event_type").alias("stage"), (F.col("_r") * 10).alias("step"), c.alias("c"))
    step_s = F.col("step").cast("string")
    line = F.concat(F.lit("Step "), step_s, F.lit(" | Loss: "),
                    F.floor(F.col("c") / 10000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((F.col("c") % 10000).cast("string"), 4, "0"),
                    F.lit(" | LR: 1.00e-03 | "), step_s, F.lit(".5m"))
    return q.select("stage", "step", line.alias("line"))


def evals(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation responses of two checkpoints (whole documents as responses)."""
    d = table(spark, sf, "documents")
    did = F.col("doc_id")
    return d.select(
        did, F.when(did % 2 == 0, "step_500").otherwise("step_1000").alias("run"),
        F.floor(did / 2).cast("bigint").alias("prompt_id"), F.col("lang").alias("suite"),
        F.col("text").alias("response"), (F.col("n_chars") % 64).alias("tokens"),
        ((did % 5) * 0.5).alias("elapsed_s"))


def tensor_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted tensor names with shape, element size and trainable flag."""
    li = table(spark, sf, "lineitem")
    ok = F.col("l_orderkey")
    part = (F.when(F.col("l_returnflag") == "A", "attn").when(F.col("l_returnflag") == "N", "mlp")
            .otherwise("gate"))
    name = F.concat(F.lit("model."),
                    F.when(ok % 2 == 0, "visual.blocks.").otherwise("layers."),
                    (F.col("l_partkey") % 27).cast("string"), F.lit("."), part,
                    F.lit(".w"), ok.cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    return li.select(name.alias("name"), (F.col("l_suppkey") + 1).alias("dim0"),
                     F.col("l_quantity").cast("bigint").alias("dim1"),
                     F.lit(2).alias("elem_bytes"), (F.col("l_linestatus") == "O").alias("trainable"))
