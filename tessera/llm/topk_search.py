"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components become the integers floor(scale * x); its non-zero ones
are the terms of a sparse row.  Candidates are packed into blocks of postings:
for each term the block's rows that have it, with their weights.  A query
visits its terms one by one and scatters weight times weight into a dense
array with a score for every row of the block; selection by partition then
leaves its best rows of the block, and the best of all blocks are merged.

Queries travel in packets to every block, so the work is a grid of (packet,
block) pieces of bounded size that Spark deals out and can repeat one by one.
Nothing is broadcast, no queries or candidates pass through the driver, and a
packet is shuffled once per block.  All candidates are scored: the result is
exact.

Defined results: a vector that is null or has a null or non-finite component,
and a row with a null id, takes no part; an empty vector, and one of zeros,
scores 0 with all; vectors of different lengths meet in their common
components; ties go to the smaller id; rows that repeat an id are rows of
their own, each a query if the id is one and each a candidate for the other;
with fewer than k candidates there are fewer ranks; components beyond 64 bits
saturate and scores are 64-bit sums that wrap; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ranking import global_rank

from .common import written

SCALE = 256
K = 5
#: Bounds of a block and of a packet: rows, and terms in all.
BLOCK_ROWS, BLOCK_TERMS = 1 << 16, 1 << 22
PACKET_ROWS, PACKET_TERMS = 1 << 9, 1 << 17
#: Scores held at once, or one query's if its block has more rows.
TILE = 1 << 18


class Rows:
    """Sparse integer rows: ids, and terms and weights of each, end to end."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, places: np.ndarray):
        self.ids, self.sizes, self.terms, self.weights, self.places = ids, sizes, terms, weights, places


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(scale * values.astype(np.float64))
    return np.clip(x, -2.0 ** 63, np.nextafter(2.0 ** 63, 0)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of the integer types."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for t in (np.int16, np.int32):
        if np.iinfo(t).min <= low and high <= np.iinfo(t).max:
            return x.astype(t)
    return x


def _pack(*arrays: np.ndarray) -> list[bytes]:
    """Arrays as bytes, the first byte of each its item size."""
    return [bytes([a.dtype.itemsize]) + a.tobytes() for a in arrays]


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1)


POSTINGS = ["ids", "terms", "counts", "holders", "weights"]
PACKET = ["ids", "places", "sizes", "terms", "weights"]


def postings(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """A block: its ids, ascending as rows are; and per term, ascending, how
    many rows hold it, which (none listed where all do), and their weights."""
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.argsort(terms, kind="stable")  # rows stay ascending within a term
    held, counts = np.unique(terms, return_counts=True)
    some = np.repeat(counts < len(ids), counts)
    return _pack(ids, held.astype(np.int64), counts.astype(np.int64), owner[order][some], _narrow(weights[order]))


class Block:
    """A block opened for accumulation."""

    def __init__(self, row: dict):
        self.ids = _unpack(row["ids"])
        terms, counts, holders, weights = (_unpack(row[c]) for c in POSTINGS[1:])
        self.greatest = int(np.abs(weights.astype(np.float64)).max()) if len(weights) else 0
        self.lists, at, listed = {}, 0, 0
        for term, n in zip(terms.tolist(), counts.tolist(), strict=True):
            full = n == len(self.ids)
            self.lists[term] = (None if full else holders[listed:listed + n], weights[at:at + n])
            at, listed = at + n, listed + (0 if full else n)
        self.wide = {}

    def of(self, dtype) -> dict:
        """The posting lists with weights of one type."""
        if dtype not in self.wide:
            self.wide = {dtype: {t: (h, w.astype(dtype)) for t, (h, w) in self.lists.items()}}
        return self.wide[dtype]

    def scores(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A dense array of scores, a row per query and a column per row of
        the block, accumulated term by term."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(owner, np.abs(weights.astype(np.float64)), minlength=len(sizes))
        dtype = np.int32 if sums.max(initial=0) * self.greatest < 2.0 ** 31 else np.int64
        lists, shape = self.of(dtype), (len(sizes), len(self.ids))
        out, part = np.zeros(shape, dtype), np.empty(shape, dtype)
        order = np.argsort(terms, kind="stable")
        owner, weights = owner[order], weights[order].astype(dtype)
        held, starts = np.unique(terms[order], return_index=True)
        ends = [*starts.tolist()[1:], len(terms)]
        for term, a, b in zip(held.tolist(), starts.tolist(), ends, strict=False):
            holders, values = lists.get(term, (None, None))
            if values is None:
                continue
            if holders is None and b - a == len(sizes):  # all queries and all rows have the term
                out += np.multiply.outer(weights[a:b], values, out=part)
            elif holders is None:
                out[owner[a:b]] += np.multiply.outer(weights[a:b], values)
            else:  # a query and a row have a term once
                out[owner[a:b, None], holders] += np.multiply.outer(weights[a:b], values)
        return out


def best(scores: np.ndarray, k: int, own: int | None) -> np.ndarray:
    """The rows with the k best scores, without ``own``; of equal scores the first."""
    rows = np.arange(len(scores))
    if own is not None:
        rows, scores = np.delete(rows, own), np.delete(scores, own)
    if len(rows) <= k:
        return rows
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return rows[np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])]


def _sparse(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Rows]:
    for batch in batches:
        vectors = batch.column(1)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = quantised(vectors.flatten().to_numpy(zero_copy_only=False), scale)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        term = np.arange(len(values)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        some = values != 0
        yield Rows(batch.column(0).to_numpy(), np.bincount(owner[some], minlength=len(sizes)),
                   term[some], values[some], batch.column(2).to_numpy())


def _bounded(parts: Iterator[Rows], most_rows: int, most_terms: int, consecutive: bool) -> Iterator[Rows]:
    """The rows of a task in groups of bounded size; of ``consecutive`` places
    if asked for."""
    held: list[Rows] = []
    n = terms = 0

    def joined():
        return Rows(*(np.concatenate([getattr(r, a) for r in held])
                      for a in ("ids", "sizes", "terms", "weights", "places")))

    for rows in parts:
        starts = np.r_[0, np.cumsum(rows.sizes)]
        ends = np.r_[np.flatnonzero(np.diff(rows.places) != 1) + 1, len(rows.ids)] if consecutive else [len(rows.ids)]
        i = 0
        while i < len(rows.ids):
            end = int(ends[np.searchsorted(ends, i, "right")])
            room = int(np.searchsorted(starts, starts[i] + most_terms - terms, "right")) - 1 - i
            j = min(end, i + max(room, 0 if n else 1), i + most_rows - n)
            if held and (j <= i or consecutive and rows.places[i] != held[-1].places[-1] + 1):
                yield joined()
                held, n, terms = [], 0, 0
                continue
            a, b = starts[i], starts[j]
            held.append(Rows(rows.ids[i:j], rows.sizes[i:j], rows.terms[a:b], rows.weights[a:b], rows.places[i:j]))
            n, terms, i = n + j - i, terms + int(b - a), j
    if n:
        yield joined()


def _blocks(batches, scale, most_rows, most_terms) -> Iterator[pa.RecordBatch]:
    for rows in _bounded(_sparse(batches, scale), most_rows, most_terms, True):
        packed = postings(rows.ids, rows.sizes, rows.terms, rows.weights)
        yield pa.record_batch([pa.array([x]) for x in [int(rows.places[0]), *packed]], names=["first", *POSTINGS])


def _packets(batches, scale, most_rows, most_terms) -> Iterator[pa.RecordBatch]:
    for rows in _bounded(_sparse(batches, scale), most_rows, most_terms, False):
        packed = _pack(rows.ids, rows.places, rows.sizes, rows.terms, _narrow(rows.weights))
        yield pa.record_batch([pa.array([x]) for x in packed], names=PACKET)


FOUND = "place long, query_id long, vec_id long, score long"


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    opened, block = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            first = row.column(0)[0].as_py()
            if first != opened:
                values = {c: row.column(j + 1)[0].as_py() for j, c in enumerate(POSTINGS)}
                opened, block = first, Block(values)
            ids, places, sizes, terms, weights = (_unpack(row.column(len(POSTINGS) + 1 + j)[0].as_py())
                                                  for j in range(len(PACKET)))
            starts = np.r_[0, np.cumsum(sizes)]
            out: list[list[np.ndarray]] = [[], [], [], []]
            step = max(1, TILE // len(block.ids))
            for at in range(0, len(ids), step):
                some = slice(at, at + step)
                a, b = starts[at], starts[min(at + step, len(ids))]
                scores = block.scores(sizes[some], terms[a:b], weights[a:b])
                for place, query, own in zip(places[some], ids[some], scores, strict=True):
                    here = int(place) - first
                    rows = best(own, k, here if 0 <= here < len(own) else None)
                    for column, x in zip(out, (np.full(len(rows), place), np.full(len(rows), query),
                                               block.ids[rows], own[rows]), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in out],
                                  names=[c.split()[0] for c in FOUND.split(", ")])


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE,
           block: tuple[int, int] = (BLOCK_ROWS, BLOCK_TERMS),
           packet: tuple[int, int] = (PACKET_ROWS, PACKET_TERMS)) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each row
    of ``vectors`` (vec_id long, embedding array) for which ``is_query``, a
    condition on vec_id, holds."""
    vectors = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"),
                             vectors["embedding"].cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    # a row's place names it and is in the order of ids; blocks hold consecutive places
    ranges = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.monotonically_increasing_id()
    placed = written(vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
                     .withColumn("spread", spread).repartitionByRange(ranges, "vec_id", "spread")
                     .sortWithinPartitions("vec_id", "spread")
                     .select("vec_id", "embedding", F.monotonically_increasing_id().alias("place")), "vectors")
    blocks = written(placed.mapInArrow(lambda it: _blocks(it, scale, *block),
                                       "first long, " + ", ".join(f"{c} binary" for c in POSTINGS)), "blocks")
    packets = (placed.where(is_query).select("vec_id", "embedding", "place")
               .mapInArrow(lambda it: _packets(it, scale, *packet), ", ".join(f"{c} binary" for c in PACKET)))
    # each packet goes to every block: blocks are numbered, and a packet carries the numbers
    numbered = global_rank(blocks.select("first"), ["first"], rank_col="block")
    blocks = blocks.join(numbered, "first")
    count = numbered.agg(F.max("block")).first()[0] or 0
    numbers = F.sequence(F.lit(1), F.lit(count)) if count else F.expr("cast(array() as array<int>)")
    names = [f"q_{c}" for c in PACKET]
    dealt = packets.toDF(*names).select(*names, F.explode(numbers).alias("to"))
    grid = dealt.join(blocks, F.col("to") == F.col("block")).select("first", *POSTINGS, *names)
    found = written(grid.mapInArrow(lambda it: _searched(it, k), FOUND), "found")
    best = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
