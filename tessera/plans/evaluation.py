"""Evaluation runs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import evals as EV
from tessera.operators.joins import compare_runs
from tessera.plans import fixtures as FX
from tessera.plans.assembly import sql_values
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.registry import query
from tessera.plans.samples import sql_strip
from tessera.session import checkpoint_dir
from tessera.sources.corpus import scan_corpus

# Expected keywords and pass rule per suite (the suites are the languages).
SUITES = [("en", "the|and", "any_hit"), ("fr", "le|la", "all_tokens"),
          ("de", "der|die", "all_tokens"), ("es", "el|de", "all_hit")]
SUITES_SQL = sql_values(SUITES, ["suite", "kw", "rule"])


def suites_frame(spark):
    return spark.createDataFrame(SUITES, "suite string, kw string, rule string") \
        .withColumn("keywords", F.split("kw", r"\|")).drop("kw")


def hits_df(spark, sf):
    e = FX.evals(spark, sf)
    s = F.broadcast(suites_frame(spark))   # one row per suite: fixed size
    j = e.join(s, "suite", "left")
    return j.withColumn("hit", EV.keyword_hit("response", "keywords"))


HITS_SQL = with_fixtures("""select e.doc_id, e.run, e.suite, e.tokens, e.elapsed_s, s.rule,
  coalesce(len(list_filter(string_split(s.kw, '|'), lambda k: contains(lower(e.response), lower(k)))) > 0, false) as hit
from evals e left join suites s on e.suite = s.suite""", "evals", extra={"suites": SUITES_SQL})


@query("keyword_hits", f"with h as ({HITS_SQL}) select doc_id, run, hit from h")
def keyword_hits(spark, sf):
    """A8 per response."""
    return hits_df(spark, sf).select("doc_id", "run", "hit")


VERDICT_SQL = """select run, suite, rule,
  case rule when 'any_hit' then coalesce(bool_or(hit), false)
            when 'all_tokens' then coalesce(bool_and(tokens > 0), true)
            when 'all_hit' then coalesce(bool_and(hit), true) else false end as passed,
  count(*) as n
from h group by run, suite, rule"""


@query("suite_verdicts", f"with h as ({HITS_SQL}) {VERDICT_SQL}")
def suite_verdicts(spark, sf):
    """A9 per (run, suite)."""
    return EV.suite_verdict(hits_df(spark, sf), ["run", "suite"])


def tests_df(spark, sf):
    """One test record per (run, suite) with its duration (sum of elapsed,
    rounded half-even to 0.1 s like the report)."""
    h = hits_df(spark, sf)
    v = EV.suite_verdict(h, ["run", "suite"])
    d = h.groupBy("run", "suite").agg(F.sum("elapsed_s").alias("_d"))
    t = v.join(d, ["run", "suite"])
    return t.select("run", F.col("suite").alias("name"), "passed",
                    F.when(~F.col("passed"), F.concat(F.lit("suite "), F.col("suite"), F.lit(" failed")))
                    .alias("error"), F.bround("_d", 1).alias("duration_s"))


TESTS_SQL = f"""select v.run, v.suite as name, v.passed,
  case when not v.passed then 'suite ' || v.suite || ' failed' end as error, round_even(d.dsum, 1) as duration_s
from ({VERDICT_SQL}) v join (select run, suite, sum(elapsed_s) as dsum from h group by run, suite) d
  on v.run = d.run and v.suite = d.suite"""


@query("eval_summary", f"""with h as ({HITS_SQL}), t as ({TESTS_SQL})
select run, count(*) filter (where passed) as passed, count(*) as total, sum(duration_s) as total_s,
  string_agg(name || ':' || case when passed then 'PASS' else 'FAIL' end, ',' order by name || ':' || case when passed then 'PASS' else 'FAIL' end) as statuses
from t group by run""")
def eval_summary(spark, sf):
    """A10 per run."""
    s = EV.eval_summary(tests_df(spark, sf), "run")
    return s.select("run", F.col("passed").cast("bigint").alias("passed"), "total",
                    F.round("total_s", 6).alias("total_s"), "statuses")


@query("eval_report", f"""with h as ({HITS_SQL}), t as ({TESTS_SQL})
select run, 'cpu' as device, name, passed, error, duration_s from t""")
def eval_report(spark, sf):
    """Report per run (header + array of test records) written as JSON
    and read back in its array-free form."""
    rep = EV.build_report(tests_df(spark, sf), "run", {"device": "cpu", "dtype": "bfloat16"})
    path = os.path.join(checkpoint_dir(spark), f"eval-report-{uuid.uuid4().hex}")
    EV.write_report(rep, path)
    back = EV.read_report(spark, path)
    r = back.select("run", "device", F.explode("results").alias("r"))
    return r.select("run", "device", F.col("r.name").alias("name"), F.col("r.passed").alias("passed"),
                    F.col("r.error").alias("error"), F.col("r.duration_s").alias("duration_s"))


RUNS = ["step_500", "step_1000"]


@query("compare_runs", with_fixtures("""
select prompt_id, max(tokens) filter (where run = 'step_500') as tokens_step_500,
       max(tokens) filter (where run = 'step_1000') as tokens_step_1000
from evals group by prompt_id""", "evals"))
def compare_runs_q(spark, sf):
    """The same prompt across checkpoints, one column per run."""
    return compare_runs(FX.evals(spark, sf), "prompt_id", "run", "tokens", RUNS)


REQ_SQL = """select doc_id, case doc_id % 6
    when 0 then 'q' when 1 then '   ' when 2 then 'text | ' || text
    when 3 then 'img_' || cast(doc_id as varchar) || '.png | ' || text
    when 4 then '  EXIT  ' else ' TEXT|' || text || ' | a | b' end as request
from documents"""


def requests_df(spark, sf):
    """A request table over the whole documents: quit words, blank input,
    text-mode and image-mode requests, and prompts with later pipes."""
    d = scan_corpus(spark, f"{sf}/documents.parquet")
    m = F.col("doc_id") % 6
    t = F.col("text")
    req = (F.when(m == 0, "q").when(m == 1, "   ").when(m == 2, F.concat(F.lit("text | "), t))
           .when(m == 3, F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".png | "), t))
           .when(m == 4, "  EXIT  ").otherwise(F.concat(F.lit(" TEXT|"), t, F.lit(" | a | b"))))
    return d.select("doc_id", req.alias("request"))


@query("route_requests", with_fixtures(f"""
select doc_id, case when lower(source) = 'text' then 'text' else 'image' end as mode, source, prompt
from (select doc_id, r,
        case when instr(r, '|') > 0 then {sql_strip("substr(r, 1, instr(r, '|') - 1)")} else r end as source,
        case when instr(r, '|') > 0 then {sql_strip("substr(r, instr(r, '|') + 1)")} end as prompt
      from (select doc_id, {sql_strip('request')} as r from req) a
      where r <> '' and lower(r) not in ('quit', 'exit', 'q')) b""", extra={"req": REQ_SQL}))
def route_requests_q(spark, sf):
    """P15 over a request table."""
    return EV.route_requests(requests_df(spark, sf), "request").select("doc_id", "mode", "source", "prompt")
