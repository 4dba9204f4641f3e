"""Suffix-array dedup: removes every byte of a long string that occurs twice.

A string of ``least`` bytes that starts at two places of the corpus, in one
document or two, goes from both.  Which starts those are is decided by
interval expansion on Burrows-Wheeler transforms (see bwt.py), one per block.

Blocks.  Each window of ``least`` bytes has a key, the smallest hash of its
``anchor``-byte strings: equal windows have equal keys, so only windows of one
key need to meet.  Consecutive windows of a document with the same key are one
segment.  A task emits a row of hashes per segment, never its text.  Equal
segments of a key are counted as one, on the map side first, so that a group
of copies, however large, is one row per task.  A segment that occurs twice
repeats at each start.  Keys with several different segments, or with one that
has the key's string in it more than once, go on: their segments' texts are
fetched once each and dealt by key, and a task builds the transforms of a few
thousand segments at a time.  Segments are at most
``longest`` starts long.

A key whose segments exceed ``block_bytes`` (a string that very many
different documents share, shorter than ``least``) is never gathered in one
task: its windows are counted by the hash of their bytes instead.

Hashes select and group; they are 64 bits for keys and 128 for segments,
windows and texts.

Defined results: a null text is empty; a text shorter than ``least`` keeps all
its bytes; repeated rows are copies of each other; an empty table gives no
rows; extra columns are ignored; a null doc_id is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bwt import repeated_starts
from .common import written
from .hashing import Hashed

LEAST = 400
ANCHOR = 128
LONGEST = 1024
BLOCK_BYTES = 4 << 20
#: A task's transform covers about so many bytes at a time.
BATCH_BYTES = 1 << 20
#: Lists of ids and spans up to this many bytes are broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by running minima of blocks."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def segments(text: bytes, least: int, anchor: int, longest: int):
    """(key, start, number of starts, whether its key's string is in it more
    than once) of each segment, as arrays, and the text's hashes."""
    hashed = Hashed(np.frombuffer(text, np.uint8))
    anchors = hashed.windows(anchor)
    keys = sliding_least(anchors, least - anchor + 1)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    parts = -(-sizes // longest)
    if (parts > 1).any():
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        upto = np.repeat(starts + sizes, parts)
        starts = np.repeat(starts, parts) + offset * longest
        sizes = np.minimum(longest, upto - starts)
    found = keys[starts]
    # places of the keys' strings: by 16 bits first, then exactly
    distinct = np.unique(found)
    table = np.zeros(1 << 16, bool)
    table[(distinct & np.uint64(0xFFFF)).astype(np.int64)] = True
    places = np.flatnonzero(table[(anchors & np.uint64(0xFFFF)).astype(np.int64)])
    which = np.minimum(np.searchsorted(distinct, anchors[places]), len(distinct) - 1)
    exact = distinct[which] == anchors[places]
    n = len(anchors) + 1
    ordered = np.sort(which[exact] * n + places[exact])
    base = np.searchsorted(distinct, found) * n
    upto = np.minimum(starts + sizes + (least - anchor), n - 1)
    again = np.searchsorted(ordered, base + upto) - np.searchsorted(ordered, base + starts) > 1
    return found, starts, sizes, again, hashed


def _segment_rows(batches: Iterator[pa.RecordBatch], least: int, anchor: int, longest: int) -> Iterator[pa.RecordBatch]:
    names = ["text_id", "key", "seg", "seg2", "start", "n", "again"]

    def block():
        ids = pa.array(owners, pa.binary()).take(pa.array(np.repeat(np.arange(len(owners)), counts)))
        return pa.record_batch([ids, *(pa.array(np.concatenate(c)) for c in zip(*rows, strict=True))], names=names)

    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        owners, counts, rows = [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if text is None or len(text) < least:
                continue
            key, start, n, again, hashed = segments(text, least, anchor, longest)
            # two independent hashes of a segment's bytes: its whole, and its halves in turn
            end = start + n + least - 1
            middle = (start + end) // 2
            whole, left, right = hashed.of(start, end), hashed.of(start, middle), hashed.of(middle, end)
            second = (left * np.uint64(0xFF51AFD7ED558CCD)) ^ (right + (right << np.uint64(31)))
            owners.append(md5(text).digest())
            counts.append(len(key))
            rows.append((key.view(np.int64), whole.view(np.int64), second.view(np.int64), start.astype(np.int32),
                         n.astype(np.int32), again))
            if sum(counts) > 100_000:
                yield block()
                owners, counts, rows = [], [], []
        if rows:
            yield block()


def _bodies(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        out = {"key": [], "seg": [], "seg2": [], "body": []}
        held = 0
        for i, wanted in enumerate(batch.column(1)):
            text = texts[i].as_py()
            for w in wanted.as_py():
                for k in ("key", "seg", "seg2"):
                    out[k].append(w[k])
                out["body"].append(text[w["start"]:w["start"] + w["n"] + least - 1])
                held += len(out["body"][-1])
            if held > BATCH_BYTES * 4:
                yield pa.record_batch([pa.array(v, pa.binary() if k == "body" else pa.int64()) for k, v in out.items()],
                                      names=list(out))
                out, held = {k: [] for k in out}, 0
        yield pa.record_batch([pa.array(v, pa.binary() if k == "body" else pa.int64()) for k, v in out.items()],
                              names=list(out))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _expanded(batches: Iterator[pa.RecordBatch], least: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated starts per segment; rows come sorted by key, and a
    block ends between two keys only."""

    def block():
        found = []
        for flags in repeated_starts([r[3] for r in rows], least):
            a, b = runs(flags)
            found.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)])
        return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] +
                               [pa.array(found, RANGES)], names=["key", "seg", "seg2", "ranges"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held >= batch_bytes and row[0] != rows[-1][0]:
                yield block()
                rows, held = [], 0
            rows.append(row)
            held += len(row[3])
    if rows:
        yield block()


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row per window of a segment: two hashes of its bytes, and where it is."""
    for batch in batches:
        bodies = batch.column(3)
        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            hashed = Hashed(np.frombuffer(body, np.uint8))
            at = np.arange(len(body) - least + 1)
            half = least // 2
            whole, left = hashed.of(at, at + least), hashed.of(at, at + half)
            right = hashed.of(at + half, at + least)
            second = (left * np.uint64(0xFF51AFD7ED558CCD)) ^ (right + (right << np.uint64(31)))
            ids = [pa.array(np.full(len(at), batch.column(k)[i].as_py(), np.int64)) for k in range(3)]
            yield pa.record_batch([*ids, pa.array(at.astype(np.int32)), pa.array(whole.view(np.int64)),
                                   pa.array(second.view(np.int64))], names=["key", "seg", "seg2", "at", "w", "w2"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        n_bytes, n_removed, kept, starts, ends = [], [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text = texts[i].as_py() or b""
            merged: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            cut = [0, *(x for m in merged for x in m), len(text)]
            digest = sha256()
            for a, b in zip(cut[::2], cut[1::2], strict=True):
                digest.update(text[a:b])
            n_bytes.append(len(text))
            n_removed.append(sum(b - a for a, b in merged))
            kept.append(digest.hexdigest())
            starts.append([m[0] for m in merged])
            ends.append([m[1] for m in merged])
        yield pa.record_batch(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept_sha256"])


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df``, to be broadcast if the sum of ``size`` over its rows allows it."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


SEGMENT = ["key", "seg", "seg2"]


def repeated_ranges(texts: DataFrame, least: int, anchor: int, longest: int, block_bytes: int,
                    batch_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(segments of the texts, ranges of repeated starts per segment) of the
    column ``text``."""
    found = written(texts.select("text").mapInArrow(
        lambda it: _segment_rows(it, least, anchor, longest),
        "text_id binary, key long, seg long, seg2 long, start int, n int, again boolean"), "segments")
    distinct = found.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("copies"), F.min(
        F.struct("text_id", "start", "n")).alias("at"), F.max("again").alias("again"))
    own = Window.partitionBy("key")
    distinct = (distinct.withColumn("segs", F.count(F.lit(1)).over(own))
                .withColumn("bytes", F.sum(F.col("at.n").cast("long") + least - 1).over(own)))
    distinct = written(distinct.where("segs > 1 or copies > 1 or again"), "distinct")
    whole = distinct.where("copies > 1").select(*SEGMENT, F.array(F.struct(
        F.lit(0).alias("a"), F.col("at.n").alias("b"))).alias("ranges"))

    # the texts of segments that share a key with others
    wanted = written(distinct.where("segs > 1 or again").groupBy("at.text_id").agg(F.collect_list(F.struct(
        *SEGMENT, "at.start", "at.n")).alias("wanted")), "wanted")
    ids = wanted.select("text_id")
    docs = texts.select("text", _text_id(F.col("text")).alias("text_id")).join(
        _small(ids, F.lit(64)), "text_id", "left_semi").dropDuplicates(["text_id"])
    bodies = written(docs.join(wanted, "text_id").select("text", "wanted").mapInArrow(
        lambda it: _bodies(it, least), "key long, seg long, seg2 long, body binary"), "bodies")
    over = written(distinct.where(F.col("bytes") > block_bytes).select("key").distinct(), "over")
    ranges_type = "array<struct<a:int,b:int>>"
    blocks = (bodies.join(_small(over, F.lit(16)), "key", "left_anti").repartition("key").sortWithinPartitions("key")
              .mapInArrow(lambda it: _expanded(it, least, batch_bytes),
                          f"key long, seg long, seg2 long, ranges {ranges_type}"))
    ranges = whole.unionByName(blocks)
    if not over.isEmpty():
        windows = bodies.join(_small(over, F.lit(16)), "key", "left_semi").mapInArrow(
            lambda it: _windows(it, least), "key long, seg long, seg2 long, at int, w long, w2 long")
        twice = windows.groupBy("key", "w", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        ranges = ranges.unionByName(windows.join(twice, ["key", "w", "w2"]).groupBy(*SEGMENT).agg(F.collect_list(
            F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("ranges")))
    return found, written(ranges.where(F.size("ranges") > 0), "ranges")


def without_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, longest: int = LONGEST,
                    block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, the
    removed runs as byte offsets (``starts``, ``ends``, end exclusive) and the
    SHA-256 of what remains."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    found, ranges = repeated_ranges(docs, least, anchor, longest, block_bytes, batch_bytes)
    spans = (found.join(ranges, SEGMENT).select("text_id", "start", F.explode("ranges").alias("r"))
             .select("text_id", F.struct((F.col("start") + F.col("r.a")).cast("long").alias("a"),
                                         (F.col("start") + F.col("r.b") + (least - 1)).cast("long").alias("b")).alias("s"))
             .groupBy("text_id").agg(F.collect_set("s").alias("spans")))
    spans = written(spans, "spans")
    spans = _small(spans, F.size("spans") * 24 + 64)
    text_id = _text_id(F.col("text"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return (docs.withColumn("text_id", text_id).join(spans, "text_id", "left").select("doc_id", "text", "spans")
            .mapInArrow(_kept, f"doc_id {doc_id}, n_bytes long, n_removed long, starts array<long>, ends array<long>, "
                               "kept_sha256 string"))
