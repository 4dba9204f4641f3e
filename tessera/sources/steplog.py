"""Step-log source.

Three line formats are logged by the trainers:
  Step N | Loss: x | LR: y | S samp/s | M.Mm
  Step N | Loss: x | LR: y | M.Mm
  Step N | Loss: x | LR: y | Elapsed: M.Mm
Each optional field has its own ``regexp_extract``; numbers go through
``try_cast`` (a malformed field is null, not a failed job).  Lines that are
not step lines ("  Saved: …", "  New best: …") are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: the step-line grammar.
STEP_RE = r"^Step (\d+) \|"
LOSS_RE = r"\| Loss: ([0-9.]+)"
LR_RE = r"\| LR: ([0-9.]+(?:[eE][-+]?[0-9]+)?)"
SAMP_RE = r"\| ([0-9.]+) samp/s"
ELAPSED_RE = r"\| (?:Elapsed: )?([0-9.]+)m\s*$"


def _num(line: Column, pattern: str, kind: str = "double") -> Column:
    v = F.regexp_extract(line, pattern, 1)
    return F.when(v != "", v).try_cast(kind)


def parse_step_lines(df: DataFrame, line_col: str = "value") -> DataFrame:
    line = F.col(line_col)
    return df.where(line.rlike(STEP_RE)).select(
        *[c for c in df.columns if c != line_col],
        _num(line, STEP_RE, "bigint").alias("step"), _num(line, LOSS_RE).alias("loss"),
        _num(line, LR_RE).alias("lr"), _num(line, SAMP_RE).alias("samp_s"),
        _num(line, ELAPSED_RE).alias("elapsed_min"))


def scan_step_log(spark: SparkSession, path: str, stage_col: str = "stage", line_col: str | None = None) -> DataFrame:
    """Text logs under ``path``.  The stage comes from a ``stage=…``
    partition folder when the logs are laid out that way, else from the file
    name (``<stage>.log``) via the file-source metadata column.  ``line_col``
    adds where a line stands: files by time of writing and name, lines by split
    and by their order in it."""
    raw = spark.read.text(path)
    columns = ["value"]
    if stage_col in raw.columns:
        columns.append(stage_col)
    else:
        columns.append(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.log)?$", 1).alias(stage_col))
    if line_col:
        m = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path", "file_block_start")]
        columns.append(F.struct(*m, F.monotonically_increasing_id().alias("line")).alias(line_col))
    return parse_step_lines(raw.select(*columns))
