"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each of its rows is a
bitmask over the languages, so that k reads and two ANDs return every language
that contains an n-gram.  A text's n-grams are looked up, the masks' bits are
counted per language, and the counts are corrected for the false positives
that each language's share of set bits predicts.  The language with the most
n-grams decides; its corrected share of all n-grams is the score.

N-grams are four bytes of the lower-cased text in which whatever is no letter
is a blank.  A language contains an n-gram when its frequency there is at
least ``relative`` of that in the language where it is most frequent.

The filter is fitted on at most ``per_language`` labelled documents of each
language, chosen by a hash of their id; predictions read every whole text.
The filter's size is fixed by ``rows``, whatever the input.

Defined results: a null text, or one without a letter, is ``und`` with score
0; a text with letters that matches nothing takes the most common language
with score 0; ties go to the language that sorts first; with no labelled rows
every text is ``und``; a null lang teaches nothing; repeated rows are judged
alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import filtered_in_pass, written

N = 4
HASHES = 3
ROWS = 1 << 20
PER_LANGUAGE = 20_000
RELATIVE = 0.1
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"

LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter becomes a blank.
BLANKED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, index of the text each is from) of many texts."""
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(BLANKED) + b" " for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw) + b"\0" * N, np.uint8)
    n = int(sizes.sum())
    code = np.zeros(n, np.uint32)
    for k in range(N):
        code = (code << np.uint32(8)) | data[k:n + k]
    owner = np.repeat(np.arange(len(raw)), sizes)
    ends = np.cumsum(sizes)
    keep = np.arange(n) + N <= ends[owner]  # inside one text
    keep &= (code & np.uint32(0xFFFF)) != 0x2020  # a run of blanks counts once
    keep &= (code >> np.uint32(16)) != 0x2020
    keep &= ((code >> np.uint32(8)) & np.uint32(0xFFFF)) != 0x2020
    return code[keep], owner[keep]


def slots(code: np.ndarray, rows: int) -> list[np.ndarray]:
    """The filter rows of each code."""
    shift = np.uint64(64 - int(math.log2(rows)))
    wide = code.astype(np.uint64) + np.uint64(1)
    return [((wide * m) ^ (wide * m >> np.uint64(29))) * MULTIPLIERS[0] >> shift for m in MULTIPLIERS[:HASHES]]


def _slices(texts: pa.Array, limit: int) -> Iterator[list[str]]:
    """The texts, null as empty, in slices of about ``limit`` characters; one
    slice at a time is held in Python."""
    out, held = [], 0
    for text in texts:
        out.append(text.as_py() or "")
        held += len(out[-1])
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's documents, added up per slice."""
    for batch in batches:
        for lang in pc.unique(batch.column(0)):
            own = batch.column(1).filter(pc.equal(batch.column(0), lang))
            for texts in _slices(own, 2 * SLICE_BYTES):
                code, n = np.unique(grams(texts)[0], return_counts=True)
                yield pa.record_batch([pa.array([lang.as_py()] * len(code), pa.string()),
                                       pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))],
                                      names=["lang", "gram", "n"])


def _filter_bits(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = batch.column(0).to_numpy().astype(np.uint32)
        for slot in slots(code, rows):
            yield pa.record_batch([pa.array(slot.astype(np.int64)), batch.column(1), batch.column(2)],
                                  names=["slot", "word", "mask"])


class Filter:
    """The fitted filter: languages, the bit-sliced rows (one column of 64
    languages each) and the false positive rate of each language."""

    def __init__(self, languages: list[str], bits: np.ndarray, common: int):
        self.languages, self.bits, self.common = languages, bits, common
        fill = [np.count_nonzero(self.bit(bits[:, k // 64], k)) / len(bits) for k in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def bit(words: np.ndarray, k: int) -> np.ndarray:
        return (words >> np.uint64(k % 64)) & np.uint64(1)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected count of each text and language)."""
        code, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        found = np.zeros((len(texts), len(self.languages)))
        at = slots(code, len(self.bits))
        for w in range(self.bits.shape[1]):
            column = np.ascontiguousarray(self.bits[:, w])
            masks = column[at[0]]
            for slot in at[1:]:
                masks &= column[slot]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                found[:, k] = np.bincount(owner, weights=self.bit(masks, k), minlength=len(texts))
        found = (found - total[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999))
        return total, np.maximum(found, 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and number of n-grams of each text."""
        total, found = self.counts([t or "" for t in texts])
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), total
        best = found.argmax(axis=1)
        top = found[np.arange(len(texts)), best]
        best[top == 0] = self.common
        score = np.clip(top / np.maximum(total, 1), 0, 1)
        letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
        return ([self.languages[b] if x else UNDETERMINED for b, x in zip(best, letters, strict=True)],
                np.where(letters, score, 0.0), total)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS,
        relative: float = RELATIVE) -> Filter:
    """Fit on (doc_id, text, lang); rows without text or lang teach nothing."""
    docs = labelled.select(labelled["doc_id"].alias("doc_id"), labelled["text"].alias("text"),
                           labelled["lang"].alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros((rows, 1), np.uint64), 0)
    # the same share of a language's hash range as the bound is of its documents
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where(unit < share[F.col("lang")]).select("lang", "text")
    counts = written(sample.mapInArrow(_gram_counts, "lang string, gram long, n long")
                     .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    per = F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals.get(k, 1)))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    rate = counts.select("gram", number[F.col("lang")].alias("k"), (F.col("n") / per[F.col("lang")]).alias("rate"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    members = (rate.join(top, "gram").where(F.col("rate") >= relative * F.col("top"))
               .select("gram", F.floor(F.col("k") / 64).cast("int").alias("word"),
                       F.expr("shiftleft(1L, cast(k % 64 as int))").alias("bit"))
               .groupBy("gram", "word").agg(F.bit_or("bit").alias("mask")))
    bits = (members.mapInArrow(lambda it: _filter_bits(it, rows), "slot long, word int, mask long")
            .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")))
    out = np.zeros((rows, -(-len(languages) // 64)), np.uint64)
    found = bits.toArrow()  # at most the filter's rows
    out[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(languages, out, max(range(len(languages)), key=lambda i: sizes[languages[i]]))


def _judged(texts: pa.Array, model: Filter) -> list[pa.Array]:
    """lang_pred, score and n_grams of each text."""
    langs, scores, sizes = [], [np.zeros(0)], [np.zeros(0)]
    for some in _slices(texts, SLICE_BYTES):
        lang, score, size = model.predict(some)
        langs += lang
        scores.append(score)
        sizes.append(size)
    return [pa.array(langs, pa.string()), pa.array(np.concatenate(scores)),
            pa.array(np.concatenate(sizes).astype(np.int64))]


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), *_judged(batch.column(1), model.value)],
                              names=["doc_id", "lang_pred", "score", "n_grams"])


def _accepted(batches: Iterator[pa.RecordBatch], model, least_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score, size = _judged(batch.column(1), model.value)
        known = pc.or_(pc.greater_equal(score, least_score), pc.equal(size, 0))
        yield batch.filter(pc.and_(pc.not_equal(lang, UNDETERMINED), known))


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score and n_grams of every row."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _predicted(it, shared),
                           f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_grams long")


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_outside_fold(docs: DataFrame) -> Filter:
    return fit(docs.where(~held_out(docs["doc_id"])))


#: Below this share of known n-grams a text is in no learned language; one too short for an n-gram is not judged.
LEAST_SCORE = 0.05


def in_a_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those that are in no learned language.

    Each row is judged by its own text in one pass over ``docs``: null and
    repeated doc_ids make no difference, equal texts share their fate, and all
    columns and the order of rows are kept.  A null text or one without a
    letter goes; with no labelled rows all go; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(fit_outside_fold(docs))
    return filtered_in_pass(docs, lambda it: _accepted(it, model, least_score))
