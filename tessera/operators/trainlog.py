"""Training-log analytics.

Stages are few (a handful of keys, each possibly a third of the rows), so
nothing here ranks or scans inside one per-stage task: count windows come
from the globally ranked micro-step index, running values from the
bucketed ``prefix_aggregate``, and top-k per stage from Spark's
window-group-limit (a per-task top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import prefix_aggregate


def accum_loss(micro: DataFrame, n: int, stage: str = "stage", idx: str = "micro_idx",
               loss: str = "loss") -> DataFrame:
    """A7 + W4: mean loss per count window of ``n`` micro-steps
    (``window = floor(idx / n)``, 1-based step); an incomplete tail window
    gives no row.  A plain group-by on (stage, window): partial aggregates
    per task, many small groups, no skew."""
    w = F.floor(F.col(idx) / n).cast("bigint")
    g = micro.groupBy(stage, w.alias("_w")).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == n).select(stage, (F.col("_w") + 1).alias("step"), "loss", "n")


def best_checkpoint(log: DataFrame, save_every: int, stage: str = "stage", step: str = "step",
                    loss: str = "loss") -> DataFrame:
    """Smallest loss among save points (``step % save_every = 0``);
    a strict ``<`` keeps the first of equal losses, i.e. the smallest step."""
    s = log.where((F.col(step) % save_every == 0) & F.col(loss).isNotNull())
    best = F.min(F.struct(F.col(loss), F.col(step)))
    return s.groupBy(stage).agg(best.alias("_b")).select(
        stage, F.col("_b")[step].alias("best_step"), F.col("_b")[loss].alias("best_loss"))


def loss_trend(log: DataFrame, stage: str = "stage", step: str = "step", loss: str = "loss") -> DataFrame:
    """First and last loss of each run and whether it went down."""
    s = log.where(F.col(loss).isNotNull())
    g = s.groupBy(stage).agg(F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss"),
                             F.count(F.lit(1)).alias("n_steps"))
    return g.withColumn("decreased", F.col("last_loss") < F.col("first_loss"))


def running_best(log: DataFrame, save_every: int, stage: str = "stage", step: str = "step",
                 loss: str = "loss", rows_per_bucket: int | None = None) -> DataFrame:
    """At each save point, the best loss before it (+inf at first) and
    whether this one is a new best (strict ``<``)."""
    s = log.where((F.col(step) % save_every == 0) & F.col(loss).isNotNull()).select(stage, step, loss)
    p = prefix_aggregate(s, loss, [step], [stage], "min", "prev_best", exclusive=True,
                         rows_per_bucket=rows_per_bucket)
    p = p.withColumn("prev_best", F.coalesce(F.col("prev_best"), F.lit(float("inf"))))
    return p.withColumn("is_new_best", F.col(loss) < F.col("prev_best"))


def tail_per_key(log: DataFrame, k: int, stage: str = "stage", step: str = "step") -> DataFrame:
    """Last ``k`` lines per stage.  ``row_number() <= k`` is planned with
    a WindowGroupLimit below the shuffle (k is far under the threshold), so
    each task ships at most k rows per stage."""
    w = Window.partitionBy(stage).orderBy(F.col(step).desc())
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k) \
        .withColumn("rank", F.col("_rn").cast("bigint")).drop("_rn")


def latest_step(log: DataFrame, stage: str = "stage", step: str = "step", line: str | None = None) -> DataFrame:
    """The step of the newest line per stage.  ``line`` names a column in
    line order (``scan_step_log(line_col=…)``): then a log that a restart
    wrote on gives the step of its last line, though an earlier one is
    greater.  Without it the step counter is the log order."""
    newest = F.max(step) if line is None else F.max_by(step, line)
    return log.groupBy(stage).agg(newest.alias("latest_step"))
