"""Fill-in-the-middle: texts cut in three and written with the middle last.

A text is units of one code point.  One fullmatch of ``(unit)*`` retains every
repetition of the unit, so that the ends of group 1 give the number of units
and, by index, both cuts; nothing steps through the text.  A match holds about
120 bytes a unit, therefore a text longer than ``WINDOW`` units is matched in
windows of that many (no unit crosses one, and the ends are offsets into the
whole text, so results do not depend on the window).

Where a text is cut, and how it is written, follow from the SHA-256 of
``<seed>:<doc_id>`` alone: retries and lost executors give the same output.

Defined results: a null text is empty; an empty text, and one that contains a
marker, stays plain, so that every output can be taken apart again; a null
doc_id hashes as the bare ``<seed>:``; repeated rows of one doc_id are cut by
the same numbers; a cut at 0, at n, or both cuts at one place leave empty
parts; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

SEED = 1
PLAIN_FROM = 90  # h3 % 100 at or above this stays plain
SPM_BELOW = 20  # h4 % 100 below this is suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

WINDOW = 1 << 20
SLICE_CHARS = 1 << 20

UNITS = regex.compile(r"(.)*", regex.DOTALL)
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of a document: the first four 32-bit numbers of its hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_ends(text: str, window: int = WINDOW) -> Iterator[list[int]]:
    """The end offset of every unit, a list for each window."""
    for at in range(0, max(len(text), 1), window):
        yield UNITS.fullmatch(text, at, min(at + window, len(text))).ends(1)


def cut(text: str, h1: int, h2: int, window: int = WINDOW) -> tuple[int, int, int]:
    """(number of units, offset of the first cut, offset of the second)."""
    if len(text) <= window:
        ends = [0, *UNITS.fullmatch(text).ends(1)]
        n = len(ends) - 1
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, ends[a], ends[b]
    n = sum(map(len, unit_ends(text, window)))
    units = sorted((h1 % (n + 1), h2 % (n + 1)))
    found, before = [0, 0], 0
    for ends in unit_ends(text, window):
        for k, u in enumerate(units):
            if before < u <= before + len(ends):
                found[k] = ends[u - before - 1]
        before += len(ends)
    return n, *found


def transformed(text: str, h1: int, h2: int, h3: int, h4: int, plain_from: int = PLAIN_FROM,
                spm_below: int = SPM_BELOW, window: int = WINDOW) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n, a, b = cut(text, h1, h2, window)
    if not text or h3 % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", len(prefix), len(middle), "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", len(prefix), len(middle), "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _transformed(batches: Iterator[pa.RecordBatch], plain_from: int, spm_below: int, window: int,
                 limit: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        draw = [batch.column(k).to_numpy() for k in range(2, 6)]
        rows, held, start = [], 0, 0
        for i in range(batch.num_rows):
            rows.append(transformed(texts[i].as_py() or "", *(int(h[i]) for h in draw), plain_from, spm_below, window))
            held += len(rows[-1][-1])
            if held >= limit or i == batch.num_rows - 1:
                yield pa.record_batch([ids.slice(start, len(rows)),
                                       *map(pa.array, map(list, zip(*rows, strict=True)), types)], names=names)
                rows, held, start = [], 0, i + 1


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
                   window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars,
    middle_chars and the ``output`` text."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), *draws(docs["doc_id"], seed))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: _transformed(it, plain_from, spm_below, window, slice_chars),
                           f"doc_id {doc_id}, {RESULT}")


def restored(form: Column, output: Column) -> Column:
    """The text of an output: no part contains a marker, so the markers are
    where the output is cut."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), "<[PSM]>")
    return (F.when(form == "psm", F.concat(parts[0], parts[2], parts[1]))
            .when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(output))
