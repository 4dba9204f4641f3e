"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/corpus/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and
    a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A task takes so many short rows at least, where there are more tasks than that.
FEW_ROWS = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` short rows, in no more partitions than
    they are worth: what follows on a short table needs no shuffle."""
    return df.coalesce(max(1, -(-rows // FEW_ROWS)))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # built-in lower is the same on pure ASCII, and faster there
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``at_file`` and ``at_row``, which name a row
    whatever its other columns hold: the file (by the hash of its path) and
    the row's number in it.  The same rows get the same names on every read.
    Rows that do not come from files are written first."""
    def named(df: DataFrame) -> DataFrame:
        return df.select(*[df[c] for c in docs.columns], F.xxhash64("_metadata.file_path").alias("at_file"),
                         F.col("_metadata.row_index").alias("at_row"))

    try:
        found = named(docs)
    except AnalysisException:
        docs = written(docs, "rows")
        found = named(docs)
    files = docs.select(F.col("_metadata.file_path").alias("path")).groupBy("path").count()
    if not files.groupBy(F.xxhash64("path")).count().where("count > 1").isEmpty():
        raise ValueError("two files have one hash: rename one")
    return found


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): ``row`` is a struct of all other columns, so that none of
    them can clash with what an operator adds."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns if c.lower() != "text"]).alias("row"),
                       docs["text"].alias("text"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` packed."""
    return rows.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in columns])


def filtered_in_pass(docs: DataFrame, judge: Callable) -> DataFrame:
    """The rows of ``docs`` that ``judge`` leaves in batches of (row, text), in
    one pass: nothing is joined or shuffled."""
    rows = packed(docs)
    return unpacked(rows.mapInArrow(judge, rows.schema), docs.columns)


#: ``looked_up`` broadcasts the keys with more than this share of all rows: fewer than 1 / HOT_SHARE.
HOT_SHARE = 1 / 4096


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, values: list[str]) -> DataFrame:
    """``rows`` inner-joined with the ``values`` of ``table``, which has each
    ``key`` once and in ``count`` how many of the rows have it.  The few keys
    that hold a large share of the rows are looked up in a broadcast table of
    bounded size; no other is a hot key of the shuffle."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > HOT_SHARE * total).select(key, F.struct(*values).alias("_hot"))
    rows = rows.join(F.broadcast(hot), key, "left")
    found = rows.where("_hot is not null").select("*", *[F.col("_hot")[v].alias(v) for v in values]).drop("_hot")
    rest = rows.where("_hot is null").drop("_hot").join(table.select(key, *values), key)
    return found.unionByName(rest)
