"""Records of changing schema from JSON lines, and configs with unreadable
files (S1, S2, P1, P2, F4, F6)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import fields, gates
from tessera.plans import fixtures as FX
from tessera.plans.artifacts import shared
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.registry import query
from tessera.plans.samples import sql_strip
from tessera.session import checkpoint_dir
from tessera.sources.corpus import scan_config_files, scan_corpus, scan_records


def write_json_lines(spark, sf) -> str:
    """The grounding records as JSON lines of three schemas; some lines are cut."""
    g = FX.gui_targets(spark, sf)
    sid = F.col("sample_id").alias("id")
    as_dict = F.to_json(F.struct(sid, "instruction", F.struct("x", "y").alias("target")))
    as_list = F.to_json(F.struct(sid, F.col("instruction").alias("query"), F.array("x", "y").alias("answer")))
    as_text = F.to_json(F.struct(sid, "instruction", F.col("target_text").alias("action"), F.lit("gui").alias("origin")))
    line = F.when(F.col("kind") == "dict", as_dict).when(F.col("kind") == "list", as_list).otherwise(as_text)
    line = F.when(F.col("sample_id") % 23 == 0, F.substr(line, F.lit(1), F.lit(12))).otherwise(line)
    path = os.path.join(checkpoint_dir(spark), f"json-lines-{uuid.uuid4().hex}")
    g.select(line.alias("value")).write.text(path)
    return path


def resolved_records(spark, sf):
    """(good, rejected) of the JSON lines, from one pass over them."""
    def build():
        r = scan_records(spark, write_json_lines(spark, sf))
        instruction = F.try_variant_get(fields.record_field("record", ["instruction", "query"]), "$", "string")
        target = fields.record_field("record", ["target", "answer", "action"])
        r = r.select("line", F.try_variant_get("record", "$.id", "bigint").alias("sample_id"),
                     F.col("record").isNull().alias("bad"), F.coalesce(instruction, F.lit("")).alias("instruction"),
                     target.isNull().alias("no_target"), fields.canonical_target_variant(target).alias("target"))
        return gates.quarantine_written(r, [
            ("bad line", F.col("bad")), ("missing instruction", F.col("instruction") == ""),
            ("missing target", F.col("no_target")), ("no coordinates", F.col("target").isNull())])
    return shared(spark, sf, "json-records", build)


RECORDS_SQL = {"r": f"""select sample_id, instruction, case when sample_id % 23 = 0 then 'bad line'
    when coalesce(instruction, '') = '' then 'missing instruction'
    when kind <> 'str' and (x is null or y is null) then 'no coordinates' end as reason,
  case when kind = 'str' then {sql_strip('target_text')}
       else 'click(x=' || printf('%.4f', x) || ', y=' || printf('%.4f', y) || ')' end as target from gui_targets"""}


@query("json_records", with_fixtures("select sample_id, instruction, target from r where reason is null",
                                     "gui_targets", extra=RECORDS_SQL))
def json_records(spark, sf):
    """S1 + P1 + P2 on whole VARIANT records: aliases by the keys each has."""
    return resolved_records(spark, sf)[0].select("sample_id", "instruction", "target")


@query("json_rejects", with_fixtures("select reason as reject_reason, count(*) as n from r where reason is not null group by reason",
                                     "gui_targets", extra=RECORDS_SQL))
def json_rejects(spark, sf):
    """F6 of the same pass: rejected lines by reason."""
    return resolved_records(spark, sf)[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


CONFIGS = ("en", "fr", "de")
BROKEN = "fr"


def write_configs(spark, sf) -> dict[str, str]:
    """A folder of files per config; one has a file that is no Parquet."""
    d = scan_corpus(spark, f"{sf}/documents.parquet")
    root, out = os.path.join(checkpoint_dir(spark), f"configs-{uuid.uuid4().hex}"), {}
    for c in CONFIGS:
        out[c] = os.path.join(root, c)
        d.where(F.col("lang") == c).repartition(3).write.parquet(out[c])
    (d.where(F.col("lang") == BROKEN).select(F.concat(F.lit("not a table: "), F.col("doc_id").cast("string")))
     .coalesce(1).write.mode("append").text(out[BROKEN]))
    return out


@query("config_files", f"""
select lang as config, count(*) as n_rows, case lang when '{BROKEN}' then 1 else 0 end as n_failed
from documents where lang in {CONFIGS} group by lang""")
def config_files(spark, sf):
    """S2 by file: the rows of every readable file, and the files that are not."""
    union, report = scan_config_files(spark, shared(spark, sf, "configs", lambda: write_configs(spark, sf)))
    rows = union.groupBy("config").agg(F.count("doc_id").alias("n_rows"))
    failed = report.groupBy("config").agg(F.sum((~F.col("ok")).cast("int")).cast("int").alias("n_failed"))
    return rows.join(failed, "config").select("config", "n_rows", "n_failed")
