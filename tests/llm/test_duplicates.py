"""Suffix-array dedup, Jaccard join and exact dedup against brute force."""

import hashlib
import random
import sys
import tracemalloc
from collections import Counter
from zlib import decompress

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bwt, exact_dedup, jaccard_join, substring_dedup
from tessera.llm.common import few, written
from tessera.llm.components import components


def test_repeated_starts_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(120):
        least = rnd.choice([3, 5, 8, 20])
        base = bytes(rnd.choices(rnd.choice([b"ab", b"a", b"abc\0", bytes(range(256))]), k=rnd.randint(1, 200)))
        segs = []
        for _ in range(rnd.randint(1, 8)):
            a = rnd.randrange(len(base))
            segs.append(base[a:a + rnd.randint(1, 80)] + bytes(rnd.choices(b"ab\0", k=rnd.randint(0, 10))))
        seen = Counter(s[i:i + least] for s in segs for i in range(len(s) - least + 1))
        want = [[seen[s[i:i + least]] > 1 for i in range(len(s) - least + 1)] for s in segs]
        assert [x.tolist() for x in bwt.repeated_starts(segs, least)] == want


def removed(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p:p + least] for x in raw for p in range(len(x) - least + 1))
    out = []
    for x in raw:
        mask = bytearray(len(x))
        for p in range(len(x) - least + 1):
            if seen[x[p:p + least]] > 1:
                mask[p:p + least] = b"\1" * least
        kept = bytes(c for c, m in zip(x, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(x)) if mask[k] and not (k and mask[k - 1]))
        out.append((len(x), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_passages(seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "ε", "zeta", "eta"]

    def text(n):
        return " ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(n))

    passages = [text(20) for _ in range(3)]
    texts = [None, "", "short", "na " * 200, "xyz" * 100, "na " * 90]
    for i in range(40):
        t = text(rnd.randrange(5, 60))
        p = rnd.choice(passages)
        cut = rnd.randrange(len(p) // 2)
        texts.append(t + p[cut:] + text(5) if i % 3 else t)
    return texts + [texts[10], texts[10], texts[11] + "!"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_substrings(docs_of, block_bytes):
    """With small blocks, keys of many segments take the way of window hashes."""
    texts = repeated_passages()
    rows = substring_dedup.without_repeats(docs_of(texts), least=60, anchor=20, longest=50, block_bytes=block_bytes,
                                           batch_bytes=2000).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == removed(texts, 60)


def test_substrings_of_odd_texts(docs_of, odd):
    rows = substring_dedup.without_repeats(docs_of(odd)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(odd))] == removed(odd, 400)
    assert substring_dedup.without_repeats(docs_of(odd).limit(0)).count() == 0


def sets(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def component_ids(texts):
    s = [sets(t) for t in texts]
    at = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) and at[i] != at[j]:
                at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
    return [(len(x), a) for x, a in zip(s, at, strict=True)]


def near_copies():
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    line = "This Common line stands in very many of the texts here ."
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 12, 40, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 12])):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            texts.append(" ".join(t) + (" " + line if rnd.random() < 0.5 else ""))
    return texts + [texts[0], texts[0].upper(), None, "", " \n"]


def test_jaccard_join(docs_of):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == component_ids(texts)
    # the way without a broadcast of ids gives the same
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_duplicates(docs_of(texts), broadcast_ids=0).collect()}
    assert [got[i] for i in range(len(texts))] == component_ids(texts)


def prefix_families(seed, families=100):
    """Of 36 shingles each: a text, one with other last words, which mostly
    has the same prefix, and one with other first words, near the first only."""
    rnd, texts = random.Random(seed), []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(40)]
        family = [base, base[:-3] + [f"f{f}x{i}" for i in range(3)], [f"f{f}y{i}" for i in range(4)] + base[4:]]
        rnd.shuffle(family)
        texts += [" ".join(t) for t in family]
    return texts


def test_jaccard_join_of_families_with_a_prefix(spark, docs_of):
    """Every member of a pivot group meets the other groups, not its head only.
    No token is common here, as in a large corpus, so prefixes are by hash."""
    texts = prefix_families(3)
    join = jaccard_join._Join(jaccard_join._ids_and_texts(docs_of(texts)), 5, 80, jaccard_join.BROADCAST_IDS)
    none = spark.sparkContext.broadcast(bytes(jaccard_join.BUCKETS // 8))
    join.prefixes = written(join.docs.select("text").mapInArrow(
        lambda it: jaccard_join._prefixes(it, 5, 80, none), join.prefixes.schema), "prefixes")
    assert join.prefixes.groupBy("grp", "n").count().where("count > 1").count() > 10
    component = {bytes(r.node): bytes(r.component) for r in join.run().collect()}
    nodes = [jaccard_join.node_of(x) for x in jaccard_join.shingle_sets([t.encode() for t in texts])]
    first, got = {}, []
    for i, node in enumerate(nodes):
        got.append(first.setdefault(component.get(node, node), i))
    assert got == [c for _, c in component_ids(texts)]


def test_links_are_counted_in_full(docs_of):
    """A family of which every pair is a link, and families with some; the
    components of the two ways are the same."""
    base = [f"v{i}" for i in range(60)]
    clique = [" ".join(base[:30] + [f"z{k}"] + base[31:]) for k in range(6)]
    texts = clique + prefix_families(4, 12) + near_copies() + [clique[0].upper()]
    s = [sets(t) for t in texts]
    different = {frozenset(x) for x in s if x}
    links = {x: sum(100 * len(x & y) >= 80 * len(x | y) for y in different if y != x) for x in different}
    assert links[frozenset(s[0])] == 5
    rows = {r.doc_id: r for r in jaccard_join.near_duplicates(docs_of(texts)).collect()}
    assert [rows[i].n_links for i in range(len(texts))] == [links.get(frozenset(x), 0) for x in s]
    want = component_ids(texts)
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == want
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.component_ids(docs_of(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_jaccard_join_of_odd_texts(docs_of, odd):
    texts = [*enumerate(odd), (None, "the same text"), (3, "a")]
    rows = jaccard_join.near_duplicates(docs_of(texts)).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].n_shingles == 0 and by_id[0].component_id == 0
    assert by_id[9].component_id == by_id[8].component_id == 7
    assert jaccard_join.near_duplicates(docs_of(odd).limit(0)).count() == 0
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs_of(odd)).collect()}
    assert kept == set(range(len(odd))) - {8, 9}


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bits


def test_words_that_a_polynomial_hash_confuses(docs_of):
    one = "".join("ab"[b] for b in thue_morse(1024))
    other = "".join("ba"[b] for b in thue_morse(1024))
    texts = [one, other, f"v w x {one} y z", f"v w x {other} y z", one + "c" * 8000, other + "c" * 8000]
    rows = {r.doc_id: r.component_id for r in jaccard_join.component_ids(docs_of(texts)).collect()}
    assert rows == {i: i for i in range(len(texts))}


def test_links_through_rows_without_an_id(docs_of):
    words = [f"w{i}" for i in range(60)]
    a, n, c = words, [*words[:27], "x", *words[28:]], [*words[:27], "x", *words[28:58], "y", "z"]
    a[0] = "q"
    texts = [(1, " ".join(a)), (None, " ".join(n)), (3, " ".join(c))]
    want = component_ids([t for _, t in texts])
    rows = {r.doc_id: r.component_id for r in jaccard_join.component_ids(docs_of(texts)).collect()}
    assert len({x for _, x in want}) == 1 and rows == {1: 1, None: 1, 3: 1}
    lone = [(None, "no id here at all"), (None, "no id here at all"), (4, "something else with words")]
    rows = jaccard_join.component_ids(docs_of(lone)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (4, 4)]


def near_family(seed, n, changed):
    """Copies of one text that are all near it, and near each other or not."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = [" ".join(base)]
    for k in range(n):
        t = list(base)
        at = rnd.randrange(100)
        t[at:at + changed] = [f"c{k}x{i}" for i in range(changed)]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("changed", [4, 12])
def test_large_families(docs_of, changed):
    texts = near_family(1, 80, changed) + near_family(2, 80, changed)[1:]
    rows = {r.doc_id: r.component_id for r in jaccard_join.component_ids(docs_of(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [c for _, c in component_ids(texts)]


def test_groups_that_share_many_tokens_meet_once(spark):
    """30 groups apart with the same five tokens: each pair comes at the first
    of them only, whatever tokens of its own a group has between them."""
    rows = []
    for g in range(30):
        at = sorted([(t, t) for t in (10, 20, 30, 40, 50)] + [(10 * (g % 5) + 5, 1000 + g)])
        rows += [(token, g, 60, pos, bytes([g]), bytes([g]), (0, 60, 0, bytes([99]), bytes([99])), None)
                 for pos, (_, token) in enumerate(at)]
    rows = spark.createDataFrame(rows, "token long, grp long, n long, pos int, low binary, high binary, pivot "
                                 "struct<grp:long,n:long,pos:int,low:binary,high:binary>, sketch array<long>")
    join = jaccard_join._Join.__new__(jaccard_join._Join)
    join.percent = 80
    got = sorted((r.grp, r.grp2) for r in join.meetings(rows).collect())
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_links_move_the_components_they_touch(spark):
    """Ten nodes in five components; links inside one, across, and in a chain."""
    own = spark.createDataFrame([(i, 9, bytes([i]), bytes([i - i % 2])) for i in range(10)],
                                "grp long, n long, node binary, component binary")
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in ((0, 1), (3, 5), (4, 6), (5, 3))],
                                  "a binary, b binary")
    join = jaccard_join._Join.__new__(jaccard_join._Join)
    join.broadcast_ids = 2
    now, moves = join.merged(own, links)
    assert {r.node[0]: r.component[0] for r in now.collect()} == {
        i: 2 if 2 <= i < 8 else i - i % 2 for i in range(10)}
    assert sorted((r.component[0], r.now[0]) for r in moves.collect()) == [(4, 2), (6, 2)]


def test_few_rounds(docs_of, monkeypatch):
    """Families in which each text is near the next only, and texts apart that
    share a passage: rounds do not go on for a link each."""
    texts = []
    for f in range(6):
        words = [f"f{f}w{i}" for i in range(100)]
        texts += [" ".join(words[4 * k:4 * k + 60]) for k in range(8)]
    texts += [" ".join([f"p{i}" for i in range(12)] + [f"q{k}r{i}" for i in range(30)]) for k in range(40)]
    tables = []
    for module in (jaccard_join, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "written", lambda df, label: tables.append(label) or written(df, label))
    rows = {r.doc_id: r.component_id for r in jaccard_join.component_ids(docs_of(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [c for _, c in component_ids(texts)]
    assert tables.count("placed") <= 4


def test_short_tables_take_few_tasks(spark):
    assert few(spark.range(0, 1000, 1, 50), 1000).rdd.getNumPartitions() == 1
    assert few(spark.range(0, 1000, 1, 50), 120_000).rdd.getNumPartitions() == 3
    assert few(spark.range(0, 1000, 1, 50), 0).rdd.getNumPartitions() == 1


def test_token_counts_are_a_byte_each():
    """A task counts up to 255 a bucket in one byte, and keeps no wider copy."""
    batch = pa.record_batch([pa.array([0] * 300), pa.array(range(300)), pa.array(range(300)),
                             pa.array([f"a b c d e w{i}" for i in range(300)])],
                            names=["at_file", "at_row", "doc_id", "text"])
    tracemalloc.start()
    *_, last = jaccard_join._sketches(iter([batch]), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.concatenate([np.frombuffer(decompress(c), np.uint8) for c in last["counts"].to_pylist()])
    first = jaccard_join.bucket_of(jaccard_join.shingle_sets([b"a b c d e"])[0])
    assert counts[first].tolist() == [255] and counts.sum(dtype=int) == 255 + 300
    assert peak < 2 * jaccard_join.BUCKETS


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(64)]
    at = {}
    for a, b in links:
        at.setdefault(a, a), at.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            changed |= at[a] != m or at[b] != m
            at[a] = at[b] = m
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in at.items() if any(k in x for x in links if x[0] != x[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_groups(docs_of, odd, digest_chars):
    """A digest of one character clashes all the time: bytes decide."""
    texts = odd + [f"text {i % 7} É" for i in range(60)] + ["TEXT 3 É", "text 3 é"]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    want = {}
    for i, t in enumerate(low):
        same = [k for k, x in enumerate(low) if x == t]
        want[i] = (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    rows = exact_dedup.exact_groups(docs_of(texts), digest_chars=digest_chars, batch_bytes=1).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want
    assert len(rows) == len(texts)


def test_exact_groups_without_rows_or_ids(docs_of):
    assert exact_dedup.exact_groups(docs_of(["a"]).limit(0)).count() == 0
    rows = exact_dedup.exact_groups(docs_of([(None, "a"), (None, "a"), (3, "A"), (None, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [
        (-1, -1, 1, True), (-1, 3, 3, False), (-1, 3, 3, False), (3, 3, 3, True)]
    kept = exact_dedup.drop_copies(docs_of(["a", "A", "b"]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert "digest" in kept.columns
