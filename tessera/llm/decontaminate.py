"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows of words are the test phrases.  A shard is a run of
whole documents of one task.  Its index covers the stretches of words that
occur in the phrases at all: other words can be in no match, so leaving them
out changes no result.  Every phrase is searched backward through wavelet
ranks; its occurrences are located from sampled suffix positions and merged
into spans of words to remove.  Documents are never shuffled.

The phrases travel to the tasks in blocks of about ``block_bytes``.  A larger
benchmark takes more blocks, each a pass over the documents, and only one block
is in memory at a time, on the driver as in the tasks.

Defined results: a null text has no words; a document or item without words
has no windows; an item shorter than the window is one window; repeated rows
are judged alike; items without an id are compared but not reported by id;
an empty table on either side gives no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import packed, unpacked, written
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_WORDS = 400_000

#: A-Z lowered; every byte that is neither a letter, a digit nor beyond ASCII becomes a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))

RESULT = "n_words long, starts array<long>, ends array<long>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        phrases, ids = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                phrases.append(b" ".join(w[i:i + window]))
                ids.append(item)
        yield pa.record_batch([pa.array(phrases, pa.binary()), pa.array(ids, pa.string())], names=["phrase", "item"])


def phrase_blocks(benchmark: DataFrame, window: int,
                  block_bytes: int) -> Iterator[tuple[bool, list[tuple[bytes, str | None]]]]:
    """The distinct (phrase, item) pairs in blocks of about ``block_bytes``,
    dealt by hash, so that neither a long item nor a phrase of many items
    makes a block larger.  One block is on the driver at a time; there is
    always one, empty if there are no phrases.  With each comes whether it is
    the last."""
    items = benchmark.select(benchmark["item_id"].cast("string"), benchmark["text"])
    pairs = items.mapInArrow(lambda it: _item_windows(it, window), "phrase binary, item string").distinct()
    size = F.octet_length("phrase") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    pairs = written(pairs.withColumn("size", size), "phrases")
    n = max(1, -(-(pairs.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("phrase", "item"), F.lit(n))
    for i in range(n):
        yield i == n - 1, [(bytes(r.phrase), r.item) for r in pairs.where(block == i).select("phrase", "item").collect()]


class _Phrases:
    """One block, numbered: the vocabulary, and the phrases by length."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        self.items: dict[bytes, list[str | None]] = {}
        for phrase, item in sorted(pairs, key=lambda p: (p[0], p[1] or "")):
            self.items.setdefault(phrase, []).append(item)
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], bytes]]] = {}
        for phrase in self.items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in phrase.split(b" ")]
            by_length.setdefault(len(ids), []).append((ids, phrase))
        self.groups = [(m, np.array([ids for ids, _ in found], np.int64), [p for _, p in found])
                       for m, found in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)

    def hits(self, docs: list[np.ndarray]) -> list[tuple[list[int], list[int], set]]:
        """(span starts, span ends, items) of each document of a shard, given
        its word numbers, 0 for a word in no phrase."""
        out = [([], [], set()) for _ in docs]
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        base = np.r_[0, np.cumsum(sizes)]
        text = np.zeros(base[-1] + 1, np.int64)
        for d, at in zip(docs, base, strict=False):
            text[at + 1:at + 1 + len(d)] = d  # a 0 before each document
        known = text > 0
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        lengths = end - begin
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        place = np.repeat(begin - starts, lengths) + np.arange(lengths.sum())
        index = FMIndex(text[place], starts, len(self.vocabulary))
        cover = np.zeros(len(text) + 1, np.int64)
        for m, patterns, phrases in self.groups:
            low, high = index.search(patterns)
            count = high - low
            some = np.flatnonzero(count)
            if not len(some):
                continue
            count = count[some]
            rows = np.repeat(low[some] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            at = place[index.locate(rows)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + m, -1)
            doc = np.searchsorted(base, at - 1, side="right") - 1
            for pair in np.unique(doc * len(phrases) + np.repeat(some, count)):
                out[pair // len(phrases)][2].update(self.items[phrases[pair % len(phrases)]])
        edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(cover) > 0, False].astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            doc = int(np.searchsorted(base, a - 1, side="right") - 1)
            out[doc][0].append(int(a - 1 - base[doc]))
            out[doc][1].append(int(b - 1 - base[doc]))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_pass(batches: Iterator[pa.RecordBatch], block, first: bool, with_text: bool,
                 shard_words: int) -> Iterator[pa.RecordBatch]:
    """row, text if asked for, and what was found so far with what this block
    finds added."""
    phrases = _Phrases(block.value)
    get = phrases.vocabulary.get
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        shard: list[np.ndarray] = []
        found, n_words, held = [], [], 0
        for i in range(batch.num_rows):
            w = words(texts[i].as_py())
            n_words.append(len(w))
            shard.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
            held += len(w)
            if held >= shard_words:
                found += phrases.hits(shard)
                shard, held = [], 0
        found += phrases.hits(shard) if shard else []
        if not first:  # add to what earlier blocks have found
            before = batch.select([3, 4, 5]).to_pylist()
            found = [(*(list(x) for x in zip(*m)), s | set(p["items"])) if
                     (m := merged([*zip(p["starts"], p["ends"]), *zip(a, b)])) else ([], [], set())
                     for p, (a, b, s) in zip(before, found, strict=True)]
        out = {"row": batch.column(0), "text": batch.column(1), "n_words": pa.array(n_words, pa.int64()),
               "starts": pa.array([f[0] for f in found], pa.list_(pa.int64())),
               "ends": pa.array([f[1] for f in found], pa.list_(pa.int64())),
               "items": pa.array([sorted(x for x in f[2] if x is not None) for f in found], pa.list_(pa.string()))}
        if not with_text:
            del out["text"]
        yield pa.record_batch(list(out.values()), names=list(out))


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, shard_words: int,
              keep_text: bool) -> DataFrame:
    """``rows`` (row, text) with what is found in them: a pass for each block.
    Between passes the rows are written and the block is let go of, so that
    one block is held at a time, however many there are."""
    row, text, found = rows.schema["row"], rows.schema["text"], StructType.fromDDL(RESULT).fields
    before = None
    for last, pairs in phrase_blocks(benchmark, window, block_bytes):
        if before is not None:
            rows = written(rows, "hits")
            before.destroy()
        with_text = keep_text or not last
        block = rows.sparkSession.sparkContext.broadcast(pairs)
        rows = rows.mapInArrow(lambda it, a=(block, before is None, with_text): _search_pass(it, *a, shard_words),
                               StructType([row, *([text] if with_text else []), *found]))
        before = block
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, the merged hit spans as word
    indices (``starts``, ``ends``, end exclusive) and the ids of the ``items``
    found in it, sorted as strings."""
    rows = docs.select(docs["doc_id"].alias("row"), docs["text"].alias("text"))
    return _searched(rows, benchmark, window, block_bytes, shard_words, False).withColumnRenamed("row", "doc_id")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                    shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without those that contain a phrase of the benchmark.

    Each row is judged by its own text in the passes of the search: null and
    repeated doc_ids make no difference, equal texts share their fate, and all
    columns are kept, whatever their names.  A null or empty text stays; with
    an empty benchmark all rows stay; an empty table stays empty."""
    found = _searched(packed(docs), benchmark, window, block_bytes, shard_words, True)
    return unpacked(found.where(F.size("starts") == 0), docs.columns)
