"""Configs isolated by file, records of changing schema, quarantine in one
pass, line order of logs."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates
from tessera.operators import trainlog as TL
from tessera.sources.corpus import scan_config_files, scan_records
from tessera.sources.steplog import scan_step_log


@pytest.mark.parametrize("broken", ["a.parquet", "z.parquet"])
def test_one_broken_file(spark, scratch, broken):
    spark.range(100).select("id", F.lit("x").alias("t")).repartition(3).write.parquet(f"{scratch}/one")
    spark.range(7).select("id").write.parquet(f"{scratch}/two")
    with open(f"{scratch}/one/{broken}", "wb") as f:
        f.write(b"PAR1 no table PAR1")
    os.makedirs(f"{scratch}/none")
    with open(f"{scratch}/none/{broken}", "wb") as f:
        f.write(b"nothing")
    union, report = scan_config_files(spark, {c: f"{scratch}/{c}" for c in ("one", "none", "two")})
    assert {r.config: r["count"] for r in union.groupBy("config").count().collect()} == {"one": 100, "two": 7}
    bad = {(r.config, r.file.rsplit("/", 1)[1]) for r in report.where("not ok").collect()}
    assert bad == {("one", broken), ("none", broken)}
    assert report.where("ok").agg(F.sum("n_read")).first()[0] == 107


def test_records_and_quarantine_in_one_pass(spark, scratch):
    with open(f"{scratch}/r.jsonl", "w") as f:
        f.write('{"a": 1}\n{"b": [1, {"c": null}]}\nnot json\n{"a": null}\n\n')
    r = scan_records(spark, f"{scratch}/r.jsonl")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = r.select("line", F.col("record").isNull().alias("bad")).mapInArrow(counted, "line string, bad boolean")
    good, rejected = gates.quarantine_written(lines, [("no json", F.col("bad")), ("no a", ~F.contains("line", F.lit('"a"')))])
    assert sorted(x.line for x in good.collect()) == ['{"a": 1}', '{"a": null}']
    assert sorted((x.line, x.reject_reason) for x in rejected.collect()) == [
        ("", "no json"), ("not json", "no json"), ('{"b": [1, {"c": null}]}', "no a")]
    assert good.columns == ["line", "bad"] and seen.value == 5


def test_latest_line_of_a_restarted_log(spark, scratch):
    with open(f"{scratch}/run.log", "w") as f:
        f.writelines(f"Step {s} | Loss: 1.0 | LR: 1e-4 | 1.0m\n" for s in (1, 2, 900, 3, 4))
    log = scan_step_log(spark, f"{scratch}/run.log", line_col="at")
    assert TL.latest_step(log).first()["latest_step"] == 900
    assert TL.latest_step(log, line="at").first()["latest_step"] == 4
