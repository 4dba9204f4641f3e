"""Corpus scans.

The reference streams hub datasets row by row; here a corpus is a table
(parquet by default, JSON lines accepted) read lazily, so Catalyst prunes
columns and pushes filters into the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import col_


def scan_corpus(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame:
    """Lazy scan of one corpus split."""
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else "parquet")
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


ConfigSource = str | DataFrame | Callable[[], DataFrame]


def scan_configs(spark: SparkSession, configs: Mapping[str, ConfigSource],
                 config_col: str = "config") -> tuple[DataFrame | None, DataFrame]:
    """Multi-config scan (S2, J7): each config is read in list order, tagged
    with its name and unioned by name (missing columns become null).  A
    config that cannot be opened does not fail the rest; it is reported in
    the status table ``(config, ordinal, ok, error)``.

    The loop runs over the *list of configs* (a handful of names) on the
    driver; no data passes through it.
    """
    parts, status = [], []
    for i, (name, src) in enumerate(configs.items()):
        try:
            if isinstance(src, DataFrame):
                df = src
            elif callable(src):
                df = src()
            else:
                df = scan_corpus(spark, src)
            df.schema  # resolve now so a missing path fails here
            parts.append(df.withColumn(config_col, F.lit(name)))
            status.append((name, i, True, None))
        except Exception as e:  # noqa: BLE001 - report and continue, like the loaders
            status.append((name, i, False, str(e).splitlines()[0][:500]))
    st = spark.createDataFrame(status, "config string, ordinal int, ok boolean, error string")
    if not parts:
        return None, st
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), st


#: A Parquet file without rows is no larger than this.
EMPTY_BYTES = 1 << 20


def _without_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, content) to (file, 0) of those that are whole tables without rows."""
    for batch in batches:
        files = []
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            try:
                if pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows == 0:
                    files.append(file.as_py())
            except (pa.ArrowException, OSError):
                pass  # no table: it stays in the report without a number of rows
        yield pa.record_batch([pa.array(files, pa.string()), pa.array([0] * len(files), pa.int64())], names=["file", "none"])


def scan_config_files(spark: SparkSession, configs: Mapping[str, str],
                      config_col: str = "config") -> tuple[DataFrame | None, DataFrame]:
    """S2 with isolation by file: a file that cannot be read, wherever a task
    meets it, gives no rows and fails nothing.  The report (config, file,
    n_rows, n_read, ok) has a row per listed file: ``n_rows`` from its footer,
    null if it has none, and ``n_read``, the rows that all columns could be
    read of.  The report reads the data once more; it is a plan of its own, so
    callers that do not look at it do not pay for it.  A config without any
    readable file is reported through its files."""
    parts, reports = [], []
    for name, path in configs.items():
        listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
        reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        df = None
        for merge in ("false", "true"):  # the file asked for its schema may be the unreadable one: then ask all
            try:
                df = reader.option("mergeSchema", merge).parquet(path)
                break
            except AnalysisException:
                pass
        if df is None:  # no file has a schema
            reports.append(listed.select(F.lit(name).alias(config_col), "file", F.lit(None).cast("long").alias("n_rows"),
                                         F.lit(0).cast("long").alias("n_read")))
            continue
        file = F.col("_metadata.file_path").alias("file")
        rows = df.select(file).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
        # the hash of all columns makes the tasks decode them
        read = df.select(file, F.xxhash64(*df.columns).alias("h")).groupBy("file").agg(
            F.count("h").alias("n_read"), F.bit_xor("h").alias("h")).where("h is not null").drop("h")
        small = spark.read.format("binaryFile").load(path).where(F.col("length") <= EMPTY_BYTES).select(file, "content")
        empty = small.join(rows, "file", "left_anti").mapInArrow(_without_rows, "file string, none long")
        reports.append(listed.join(rows, "file", "left").join(empty, "file", "left").join(read, "file", "left").select(
            F.lit(name).alias(config_col), "file", F.coalesce("n_rows", "none").alias("n_rows"),
            F.coalesce("n_read", F.lit(0).cast("long")).alias("n_read")))
        parts.append(df.withColumn(config_col, F.lit(name)))
    report = reduce(DataFrame.unionByName, reports).withColumn("ok", F.coalesce(F.col("n_rows") == F.col("n_read"), F.lit(False)))
    if not parts:
        return None, report
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), report


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """S1 where every record has a schema of its own: JSON lines as (line,
    record), the whole record one VARIANT, null where a line is no JSON."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.try_parse_json("value").alias("record"))


def resolve_assets(df: DataFrame, ref_col: str, base_url: str, out_col: str = "asset_url",
                   name_pattern: str = r"^[^/\s]+\.(png|jpg|jpeg|gif|webp|bmp)$") -> DataFrame:
    """Asset reference resolution (S8): a bare image name becomes
    ``base_url + name``; an embedded asset (``data:`` URI or absolute URL)
    passes through; anything else (null, other strings) is dropped."""
    r = col_(ref_col)
    url = (F.when(r.rlike(r"^(data:|https?://)"), r)
           .when(r.rlike(name_pattern), F.concat(F.lit(base_url), r)))
    return df.withColumn(out_col, url).where(F.col(out_col).isNotNull())
