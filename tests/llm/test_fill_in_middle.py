"""Fill-in-the-middle against a plain version, and its round trip."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as fim


def brute(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TRICKY = ["<P", "a<S", "<M>", "x<P>y", "<S>", "<<P", "<P<S", ">", "a", "ab", "é\n😀", "<" * 50, "P>S>M>" * 9]


@pytest.mark.parametrize("window, slice_chars", [(1 << 20, 1 << 20), (7, 50)])
def test_outputs_and_round_trip(docs_of, odd, window, slice_chars):
    texts = odd + TRICKY + [f"text {i} 中é\n" * (i % 7 + 1) for i in range(200)]
    rows = list(enumerate(texts)) + [(None, "null id"), (None, "another"), (3, "id again"), (3, "id again"), (-4, "minus")]
    found = fim.fill_in_middle(docs_of(rows), window=window, slice_chars=slice_chars)
    found = found.withColumn("again", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple(map(repr, r))
    want = sorted([(i, *brute(i, t), t or "") for i, t in rows], key=key)
    assert sorted([tuple(r) for r in found], key=key) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_windows_of_a_very_long_text():
    text = "long é\n" * 400_000
    assert fim.cut(text, 10 ** 9 + 7, 123_456_789, window=1 << 16) == fim.cut(text, 10 ** 9 + 7, 123_456_789, 1 << 22)
    n, a, b = fim.cut(text, len(text), 0)
    assert (n, a, b) == (len(text), 0, len(text))


def test_shares_of_the_forms(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    found = {r.form: r["count"] for r in fim.fill_in_middle(rows).groupBy("form").count().collect()}
    assert abs(found["plain"] / 20_000 - 0.1) < 0.01 and abs(found["spm"] / 20_000 - 0.18) < 0.01


def test_no_rows(docs_of):
    assert fim.fill_in_middle(docs_of(["x"]).where("doc_id < 0")).collect() == []
