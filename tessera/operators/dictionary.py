"""Two-level dictionaries: array elements looked up without a row per element.

A slice is a run of rows of one task.  ``encode`` replaces the elements of an
array column by their numbers among the slice's distinct elements (Arrow's
dictionary encoding, in the tasks), so that the lookup, whatever it is, joins
one row per slice and distinct element.  ``decode`` gathers what was found as
one array per slice and maps the numbers back inside each row.

A shuffle carries distinct elements of slices and the numbered rows, never an
element occurrence; a frequent element is one row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import landed

#: A slice holds about this many elements, or one row that has more.
SLICE_ELEMENTS = 1 << 18


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _encoded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(row, values) to rows with their numbers, and entries with their values."""
    task, made = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        rows, lists = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        for a, b in _slices(sizes, most):
            some = lists.slice(a, b - a)
            coded = pc.dictionary_encode(some.flatten(), null_encoding="encode")
            offsets = pa.array([0, *pc.cumulative_sum(pa.array(sizes[a:b], pa.int32())).to_pylist()], pa.int32())
            n, entries = b - a, coded.dictionary
            number = pa.array([task + made], pa.int64())
            yield pa.record_batch(
                [pa.concat_arrays([number] * n), rows.slice(a, n), pa.ListArray.from_arrays(offsets, coded.indices),
                 pa.nulls(n, pa.int32()), pa.nulls(n, entries.type)], names=["slice", "row", "numbers", "number", "value"])
            m = len(entries)
            if m:
                yield pa.record_batch(
                    [pa.concat_arrays([number] * m), pa.nulls(m, rows.type), pa.nulls(m, pa.list_(pa.int32())),
                     pa.array(range(m), pa.int32()), entries], names=["slice", "row", "numbers", "number", "value"])
            made += 1


def encode(df: DataFrame, values: str, most: int = SLICE_ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """The rows (slice, row, numbers) of ``df``, where ``row`` has its columns
    but the array ``values``, and the entries (slice, number, value) of the
    slices.  A null array is empty; null elements are elements."""
    rest = [c for c in df.columns if c != values]
    packed = df.select(F.struct(*[F.col(c) for c in rest]).alias("row"), F.col(values).alias("values"))
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("row", packed.schema["row"].dataType),
        T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("number", T.IntegerType()),
        T.StructField("value", packed.schema["values"].dataType.elementType)])
    both = landed(packed.mapInArrow(lambda it: _encoded(it, most), schema), "slices")
    return (both.where("number is null").select("slice", "row", "numbers"),
            both.where("number is not null").select("slice", "number", "value"))


def decode(rows: DataFrame, found: DataFrame, out: str) -> DataFrame:
    """The rows of ``encode`` with their columns back and the array ``out``
    of what ``found`` (slice, number, out) has for each element."""
    tables = found.groupBy("slice").agg(
        F.sort_array(F.collect_list(F.struct("number", F.col(out).alias("x")))).alias("_t")).select(
        F.col("slice").alias("_s"), F.col("_t.x").alias("_t"))
    # a slice of rows without elements has no entries
    both = rows.join(tables, F.col("slice") == F.col("_s"), "left")
    return both.select("row.*", F.transform("numbers", lambda i: F.get("_t", i)).alias(out))
