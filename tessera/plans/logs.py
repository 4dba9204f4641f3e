"""Training-log analytics."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import trainlog as TL
from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.artifacts import shared
from tessera.plans.registry import query
from tessera.session import checkpoint_dir
from tessera.sources import steplog as SL

SAVE_EVERY = 500
ACCUM = 32


def _variant_line(stage: str, line: str, step: str, spark_side: bool):
    """Stage 'view' logs the ``Elapsed:`` format, 'purchase' the ``samp/s``
    format, the rest the plain one."""
    if spark_side:
        el = F.regexp_replace(line, r"\| ([0-9]+\.5m)$", "| Elapsed: $1")
        sp = F.regexp_replace(line, r"\| ([0-9]+\.5m)$", "| 3.2 samp/s | $1")
        return F.when(stage == "view", el).when(stage == "purchase", sp).otherwise(line)
    return (f"case {stage} when 'view' then regexp_replace({line}, '\\| ([0-9]+\\.5m)$', '| Elapsed: \\1') "
            f"when 'purchase' then regexp_replace({line}, '\\| ([0-9]+\\.5m)$', '| 3.2 samp/s | \\1') "
            f"else {line} end")


def write_step_logs(spark, sf) -> str:
    """Step logs as text, one folder per stage, with save-point lines that
    are not step lines interleaved."""
    rows = FX.step_log_rows(spark, sf)
    lines = rows.select("stage", _variant_line(F.col("stage"), F.col("line"), F.col("step"), True).alias("value"))
    saved = rows.where(F.col("step") % SAVE_EVERY == 0).select(
        "stage", F.concat(F.lit("  Saved: checkpoints/step_"), F.col("step").cast("string")).alias("value"))
    root = os.path.join(checkpoint_dir(spark), f"step-logs-{uuid.uuid4().hex}")
    lines.unionByName(saved).write.partitionBy("stage").text(root)
    return root


def step_log_folder(spark, sf) -> str:
    """The step logs of ``sf``, written once per session."""
    return shared(spark, sf, "step-logs", lambda: write_step_logs(spark, sf))


def parsed_logs(spark, sf):
    return SL.scan_step_log(spark, step_log_folder(spark, sf))


def _n(pattern: str, kind: str = "double") -> str:
    return f"try_cast(nullif(regexp_extract(line, '{pattern}', 1), '') as {kind})"


PARSED_SQL = f"""select stage, {_n(SL.STEP_RE, 'bigint')} as step, {_n(SL.LOSS_RE)} as loss, {_n(SL.LR_RE)} as lr,
  {_n(SL.SAMP_RE)} as samp_s, {_n(SL.ELAPSED_RE)} as elapsed_min
from (select stage, {_variant_line('stage', 'line', 'step', False)} as line from step_log) v"""


def _logq(body: str) -> str:
    return with_fixtures(body, "step_log", extra={"parsed": PARSED_SQL})


@query("step_log_scan", _logq("select stage, step, loss, lr, samp_s, elapsed_min from parsed"))
def step_log_scan(spark, sf):
    """Three line formats, non-step lines dropped, stage from the
    folder layout."""
    return parsed_logs(spark, sf).select("stage", "step", "loss", "lr", "samp_s", "elapsed_min")


@query("accum_loss", with_fixtures(f"""
select stage, w + 1 as step, round(avg(loss), 9) as loss, count(*) as n
from (select stage, micro_idx // {ACCUM} as w, loss from microsteps) q
group by stage, w having count(*) = {ACCUM}""", "microsteps"))
def accum_loss(spark, sf):
    """A7 + W4 over the micro-step losses (32 per optimizer step)."""
    a = TL.accum_loss(FX.microsteps(spark, sf), ACCUM)
    return a.select("stage", F.col("step").cast("bigint").alias("step"), F.round("loss", 9).alias("loss"),
                    F.col("n").cast("bigint").alias("n"))


@query("best_checkpoint", _logq(f"""
select stage, arg_min(step, (loss, step)) as best_step, min(loss) as best_loss
from parsed where step % {SAVE_EVERY} = 0 and loss is not null group by stage"""))
def best_checkpoint(spark, sf):
    return TL.best_checkpoint(parsed_logs(spark, sf), SAVE_EVERY)


@query("loss_trend", _logq("""
select stage, arg_min(loss, step) as first_loss, arg_max(loss, step) as last_loss, count(*) as n_steps,
       arg_max(loss, step) < arg_min(loss, step) as decreased
from parsed where loss is not null group by stage"""))
def loss_trend(spark, sf):
    return TL.loss_trend(parsed_logs(spark, sf))


@query("running_best", _logq(f"""
select stage, step, loss,
  coalesce(min(loss) over (partition by stage order by step rows between unbounded preceding and 1 preceding),
           'inf'::double) as prev_best,
  loss < coalesce(min(loss) over (partition by stage order by step rows between unbounded preceding and 1 preceding),
           'inf'::double) as is_new_best
from parsed where step % {SAVE_EVERY} = 0 and loss is not null"""))
def running_best(spark, sf):
    return TL.running_best(parsed_logs(spark, sf), SAVE_EVERY).select(
        "stage", "step", "loss", "prev_best", "is_new_best")


@query("tail_per_stage", _logq("""
select stage, step, loss, rank from (
  select stage, step, loss, row_number() over (partition by stage order by step desc) as rank from parsed) q
where rank <= 3"""))
def tail_per_stage(spark, sf):
    return TL.tail_per_key(parsed_logs(spark, sf).select("stage", "step", "loss"), 3)


@query("latest_step", _logq("select stage, max(step) as latest_step from parsed group by stage"))
def latest_step(spark, sf):
    return TL.latest_step(parsed_logs(spark, sf))
