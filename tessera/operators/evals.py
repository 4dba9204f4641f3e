"""Evaluation responses (A8-A10, J6 via joins, S7, P15)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import col_, py_strip


def keyword_hit(response, keywords) -> Column:
    """Any expected keyword occurs in the response, case-insensitive."""
    r = F.lower(col_(response))
    return F.coalesce(F.exists(col_(keywords), lambda k: F.contains(r, F.lower(k))), F.lit(False))


def suite_verdict(df: DataFrame, group_cols: list[str], rule_col: str = "rule", hit_col: str = "hit",
                  tokens_col: str = "tokens") -> DataFrame:
    """Per suite, ``any_hit`` (text: at least one keyword hit),
    ``all_tokens`` (image, multilingual: every response has tokens) or
    ``all_hit`` (actions: every case correct).  Empty suites pass vacuously
    for the ``all`` rules and fail for ``any``."""
    g = df.groupBy(*group_cols, rule_col).agg(
        F.bool_or(hit_col).alias("_any_hit"), F.bool_and(hit_col).alias("_all_hit"),
        F.bool_and(F.col(tokens_col) > 0).alias("_all_tok"), F.count(F.lit(1)).alias("n"))
    r = F.col(rule_col)
    passed = (F.when(r == "any_hit", F.coalesce("_any_hit", F.lit(False)))
              .when(r == "all_tokens", F.coalesce("_all_tok", F.lit(True)))
              .when(r == "all_hit", F.coalesce("_all_hit", F.lit(True))).otherwise(F.lit(False)))
    return g.select(*group_cols, rule_col, passed.alias("passed"), "n")


def eval_summary(tests: DataFrame, key: str, name_col: str = "name", passed_col: str = "passed",
                 duration_col: str = "duration_s") -> DataFrame:
    """A10: passed / total, total duration and the status list per run."""
    status = F.concat(F.col(name_col), F.lit(":"), F.when(F.col(passed_col), "PASS").otherwise("FAIL"))
    return tests.groupBy(key).agg(
        F.count_if(F.col(passed_col)).alias("passed"), F.count(F.lit(1)).alias("total"),
        F.sum(duration_col).alias("total_s"),
        F.array_join(F.sort_array(F.collect_list(status)), ",").alias("statuses"))


def build_report(tests: DataFrame, key: str, header: dict | None = None) -> DataFrame:
    """One report row per ``key``: header fields, totals and the array of
    per-test records ``{name, passed, error, duration_s}``.  The per-run
    test list is tiny (one record per suite)."""
    rec = F.struct(F.col("name"), F.col("passed"), F.col("error"), F.col("duration_s"))
    g = tests.groupBy(key).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
                               F.sort_array(F.collect_list(rec)).alias("results"))
    for k, v in (header or {}).items():
        g = g.withColumn(k, F.lit(v))
    return g


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_report(spark, path: str) -> DataFrame:
    return spark.read.json(path)


def route_requests(df: DataFrame, col: str) -> DataFrame:
    """``source | prompt`` requests split once (later pipes stay in the
    prompt); ``text`` selects text mode, any other source is an image path;
    empty requests and quit words are dropped."""
    s = py_strip(col_(col))
    kept = df.withColumn("_req", s).where((F.col("_req") != "") & ~F.lower("_req").isin(*K.QUIT_WORDS))
    parts = F.split(F.col("_req"), r"\|", 2)
    has_pipe = F.instr(F.col("_req"), "|") > 0
    source = F.when(has_pipe, py_strip(F.get(parts, 0))).otherwise(F.col("_req"))
    prompt = F.when(has_pipe, py_strip(F.get(parts, 1)))
    out = kept.withColumn("source", source).withColumn("prompt", prompt)
    mode = F.when(F.lower("source") == K.TEXT_MODE_WORD, "text").otherwise("image")
    return out.withColumn("mode", mode).drop("_req")
