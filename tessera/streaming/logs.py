"""Log streams (ST1-ST4).

The trainers append step lines to log files; a file-source stream over the
log folder replaces the polling shell loops.  Ordering is by the step
counter, not by event time, so no watermark is involved: the state of
ST1/ST2 is one row per stage (bounded by the number of stages), ST3 keeps
only incomplete count windows, and ST4 the save points, from which a late one
revises the rows after it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.steplog import parse_step_lines


def read_step_log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming S6: new log files under ``path`` (``stage=…`` folders) are
    parsed as they arrive."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(path)
    if "stage" not in raw.columns:
        raw = raw.select("value", F.regexp_extract(F.col("_metadata.file_path"),
                                                   r"([^/]+?)(\.log)?$", 1).alias("stage"))
    return parse_step_lines(raw)


def stream_latest(log: DataFrame) -> DataFrame:
    """ST1: newest step (and its loss) per stage; run in update or
    complete mode."""
    return log.groupBy("stage").agg(F.max("step").alias("latest_step"),
                                    F.max_by("loss", "step").alias("latest_loss"))


def stream_trigger(log: DataFrame, k: int, action: Callable[[DataFrame, int], None],
                   checkpoint: str, trigger: dict | None = None):
    """ST2: fire ``action`` once per stage when its step first reaches
    ``k``.  ``dropDuplicates`` remembers the stages that fired, first per
    (stage, salt), which deals a stage's many later lines to as many tasks,
    then per stage, which sees each salt once.  ``foreachBatch`` runs the
    action on the new ones.  The default trigger polls every 60 s like the
    source's watcher."""
    salted = log.where(F.col("step") >= k).withColumn("_salt", F.pmod(F.xxhash64("step"), F.lit(TRIGGER_SALTS)))
    fired = salted.dropDuplicates(["stage", "_salt"]).dropDuplicates(["stage"]).drop("_salt")
    w = fired.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "60 seconds"}))
    return w.start()


TRIGGER_SALTS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ACCUM_OUT = "stage string, step long, loss double, n long"
ACCUM_STATE = "ws array<long>, sums array<double>, counts array<long>"
WINDOWS_PER_KEY = 64


def _accum_fn(n: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage = key[0]
        frames = [f for f in pdfs if len(f)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        agg = rows.groupby("w")["loss"].agg(["sum", "count"])
        if state.exists:
            ws, sums, counts = state.get
            prev = pd.DataFrame({"sum": list(sums), "count": list(counts)}, index=list(ws))
            agg = agg.add(prev, fill_value=0)
        done = agg[agg["count"] >= n]
        open_ = agg[agg["count"] < n]
        if len(open_):
            state.update(([int(w) for w in open_.index], [float(x) for x in open_["sum"]],
                          [int(c) for c in open_["count"]]))
        elif state.exists:
            state.remove()
        if len(done):
            yield pd.DataFrame({"stage": stage, "step": [int(w) + 1 for w in done.index],
                                "loss": (done["sum"] / done["count"]).values,
                                "n": done["count"].astype("int64").values})
    return fn


def stream_accum(micro: DataFrame, n: int) -> DataFrame:
    """ST3: mean loss per count window of ``n`` micro-steps, emitted once
    when the window is complete (A7 incrementally); rows may arrive in any
    order.  State is keyed by (stage, block of 64 windows): a hot stage is
    spread over many keys, one Python call serves 64 windows, and the state
    holds only the block's open windows (completed ones are emitted and
    dropped)."""
    keyed = micro.withColumn("w", F.floor(F.col("micro_idx") / n).cast("long")) \
        .withColumn("block", F.floor(F.col("w") / WINDOWS_PER_KEY).cast("long"))
    return keyed.groupBy("stage", "block").applyInPandasWithState(
        _accum_fn(n), ACCUM_OUT, ACCUM_STATE, "append", GroupStateTimeout.NoTimeout)


REVISION = "stage string, step long, loss double, prev_best double, is_new_best boolean"


def _below(a: float, b: float) -> bool:
    """``a < b`` where NaN is the greatest number, as in SQL."""
    return a == a and (b != b or a < b)


class _RunningBest(StatefulProcessor):
    """State of a stage: its save points (step, loss and the best before it),
    and the last of them, so that a batch in step order reads nothing else."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "step long", "loss double, prev_best double")
        self.last = handle.getValueState("last", "step long, best double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, float] = {}
        for f in rows:
            new.update(zip(f["step"].astype("int64").tolist(), f["loss"].astype("float64").tolist(), strict=True))
        if not new:
            return
        last_step, best = self.last.get() if self.last.exists() else (None, float("inf"))
        known: dict[int, tuple[float, float]] = {}
        first = min(new)
        if last_step is not None and first <= last_step:
            # a late save point: what comes after it is read and gone through again
            known = {k[0]: (v[0], v[1]) for k, v in self.points.iterator()}
            before = [s for s in known if s < first]
            best = float("inf")
            if before:
                loss, prev = known[max(before)]
                best = loss if len(before) == 1 or _below(loss, prev) else prev
        out = []
        for step in sorted({*new, *(s for s in known if s >= first)}):
            loss = new[step] if step in new else known[step][0]
            value = (loss, best)
            if repr(known.get(step)) != repr(value):  # equal also where both are NaN
                self.points.updateValue((step,), value)
                out.append((key[0], step, loss, best, _below(loss, best)))
            # the first save point's loss is the best so far, even NaN
            best = loss if best == float("inf") or _below(loss, best) else best
        self.last.update((max(step, last_step if last_step is not None else step), best))
        yield pd.DataFrame(out, columns=["stage", "step", "loss", "prev_best", "is_new_best"])

    def close(self) -> None:
        pass


def stream_running_best(log: DataFrame, save_every: int) -> DataFrame:
    """ST4: the running best (W5) as it goes, in update mode.  Each save point
    gives a row when it comes; one that comes late, out of order or again (the
    loss that came last counts) also gives the rows after it that it changes
    anew.  The newest row of each (stage, step) is the running best over all
    that has come, whatever order that was in and whatever is missing.  Only
    save points (one line in ``save_every``) reach the state, which RocksDB
    keeps on disk; the session's state store provider must be that one."""
    s = log.where((F.col("step") % save_every == 0) & F.col("loss").isNotNull()).select("stage", "step", "loss")
    return s.groupBy("stage").transformWithStateInPandas(
        statefulProcessor=_RunningBest(), outputStructType=REVISION, outputMode="Update", timeMode="None")


def start_running_best(spark: SparkSession, read: Callable[[SparkSession], DataFrame], save_every: int, out: str,
                       checkpoint: str, trigger: dict | None = None):
    """Start ``stream_running_best`` of the log stream that ``read`` opens, in
    a session of its own with the state store it needs.  Every micro-batch
    writes its rows under its number, so that a replay writes the same."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}"))

    return (stream_running_best(read(session), save_every).writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def newest_revisions(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each (stage, step) under ``out``."""
    rows = spark.read.schema(REVISION + ", batch long").parquet(out)
    newest = rows.groupBy("stage", "step").agg(
        F.max_by(F.struct("loss", "prev_best", "is_new_best"), "batch").alias("r"))
    return newest.select("stage", "step", "r.*")


BEST_OUT = "stage string, step long, loss double, prev_best double, is_new_best boolean"
BEST_STATE = "best double, next long, steps array<long>, losses array<double>"


def _best_fn(save_every: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (stage,) = key
        best, due, steps, losses = state.get if state.exists else (float("inf"), save_every, [], [])
        held = dict(zip(steps, losses, strict=True))
        for f in pdfs:
            held.update(zip(f["step"].astype("int64"), f["loss"], strict=True))
        out = []
        while due in held:  # in step order, as far as no save point is missing
            loss = held.pop(due)
            if loss is not None and loss == loss:
                out.append((stage, due, loss, best, loss < best))
                best = min(best, loss)
            due += save_every
        rest = sorted((int(k), None if v is None or v != v else float(v)) for k, v in held.items() if k > due)
        state.update((best, int(due), [k for k, _ in rest], [v for _, v in rest]))
        if out:
            yield pd.DataFrame(out, columns=["stage", "step", "loss", "prev_best", "is_new_best"])
    return fn


def stream_best(log: DataFrame, save_every: int) -> DataFrame:
    """The append form of ST4: running best at each save point (W5
    incrementally), whatever order the log files arrive in.  A row that is out
    cannot be revised, so a save point is held back until all before it have
    come, for good if one never does; logs with gaps need ``stream_running_best``.
    In this form, one without a loss fills its place and gives no row.  State
    per stage: the best loss, the next save point due, and those held back.
    Only save points (one line in ``save_every``) reach the state."""
    s = log.where((F.col("step") % save_every == 0) & (F.col("step") > 0)).select("stage", "step", "loss")
    return s.groupBy("stage").applyInPandasWithState(
        _best_fn(save_every), BEST_OUT, BEST_STATE, "append", GroupStateTimeout.NoTimeout)
