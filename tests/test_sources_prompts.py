"""Step-log stage from file names (S6), history forms (P10), mixing bound
(M1), sample-level hash stability (M1-M3)."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions.prompts import history_prompt
from tessera.operators.mixture import text_probability
from tessera.sources.steplog import scan_step_log


def test_step_log_stage_from_file_name(spark, scratch):
    logs = {
        "projector": ["Step 10 | Loss: 2.1234 | LR: 1.00e-04 | 3.2 samp/s | 0.5m", "  Checkpoint: x.pt",
                      "Step 20 | Loss: 1.5000 | LR: 2.00e-04 | 3.3 samp/s | 1.0m"],
        "grounding": ["Step 5 | Loss: 0.9000 | LR: 5.00e-05 | Elapsed: 0.2m", "  New best: 0.9000"],
        "midstage": ["Step 7 | Loss: 3.0000 | LR: 1.00e-03 | 12.5m", "Step x | Loss: ?"],
    }
    d = os.path.join(scratch, "logs")
    os.makedirs(d)
    for stage, lines in logs.items():
        with open(os.path.join(d, f"{stage}.log"), "w") as f:
            f.write("\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in scan_step_log(spark, d).select(
        "stage", "step", "loss", "lr", "samp_s", "elapsed_min").collect())
    assert got == [("grounding", 5, 0.9, 5e-05, None, 0.2), ("midstage", 7, 3.0, 1e-03, None, 12.5),
                   ("projector", 10, 2.1234, 1e-04, 3.2, 0.5), ("projector", 20, 1.5, 2e-04, 3.3, 1.0)]


def test_history_forms(spark):
    df = spark.createDataFrame([
        ("a", ["h1", "h2", "h3", "h4"], None), ("b", ["h1"], None), ("c", [], None),
        ("d", None, "typed history\nline 2"), ("e", None, ""), ("f", None, None)],
        "i string, hl array<string>, ht string")
    rows = df.select(history_prompt("i", "hl", "ht").alias("p")).collect()
    assert [r["p"] for r in rows] == [
        "a\n\nPrevious actions:\nh2\nh3\nh4", "b\n\nPrevious actions:\nh1", "c",
        "d\n\nPrevious actions:\ntyped history\nline 2", "e", "f"]


def test_text_ratio_bound():
    assert text_probability(0.2) == pytest.approx(0.25)
    assert text_probability(0.5) == 1.0
    with pytest.raises(ValueError):
        text_probability(0.6)


def test_hash_sampling_independent_of_partitioning(spark):
    from tessera.functions.sampling import bernoulli
    a = spark.range(0, 5000, numPartitions=1).where(bernoulli(7, F.col("id"), 0.3))
    b = spark.range(0, 5000, numPartitions=13).where(bernoulli(7, F.col("id"), 0.3))
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    assert 1300 < a.count() < 1700
