"""ST4 in update mode equals W5 over what has come, in any order."""

import random

import pytest

from tessera.operators import trainlog as TL
from tessera.streaming import logs as SL

SCHEMA = "stage string, step long, loss double"


def _run(spark, scratch, batches, every=10):
    """Newest revisions after a stream over files, and the batch form's rows."""
    src, out = f"{scratch}/log", f"{scratch}/out"
    got = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if k % 2 or k == len(batches) - 1:  # a resumed stream goes on from its checkpoint
            SL.start_running_best(spark, lambda s: s.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src),
                                  every, out, f"{scratch}/ckpt").awaitTermination()
    got = sorted(tuple(r) for r in SL.newest_revisions(spark, out).select(
        "stage", "step", "loss", "prev_best", "is_new_best").collect())
    flat = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = sorted(tuple(r) for r in TL.running_best(flat, every).select(
        "stage", "step", "loss", "prev_best", "is_new_best").collect())
    return got, want


@pytest.mark.parametrize("order", ["in order", "late", "reversed"])
def test_equals_batch(spark, scratch, order):
    rnd = random.Random(order)
    rows = [(stage, step, None if rnd.random() < 0.1 else round(rnd.uniform(0, 5), 3))
            for stage in ("a", "b") for step in range(5, 200, 5) if rnd.random() < 0.8]  # some steps are missing
    rows.sort(key=lambda r: r[1], reverse=order == "reversed")
    if order == "late":
        rnd.shuffle(rows)
    got, want = _run(spark, scratch, [rows[i::5] if order == "late" else rows[12 * i:12 * i + 12] for i in range(5)])
    assert len(got) > 20 and got == want


def test_a_late_point_revises_only_what_changes(spark, scratch):
    got, want = _run(spark, scratch, [[("a", 10, 5.0), ("a", 30, 3.0), ("a", 40, 2.0), ("a", 50, 4.0)], [("a", 20, 2.5)]])
    assert got == want
    late = spark.read.parquet(f"{scratch}/out").where("batch = 1")
    assert sorted(r.step for r in late.collect()) == [20, 30, 40]


def test_a_repeated_step_counts_as_it_came_last(spark, scratch):
    got, _ = _run(spark, scratch, [[("a", 10, 5.0), ("a", 20, 1.0)], [("a", 20, 4.0), ("a", 30, 2.0)]])
    assert got == [("a", 10, 5.0, float("inf"), True), ("a", 20, 4.0, 5.0, True), ("a", 30, 2.0, 4.0, True)]
