"""URL filter and WARC."""

import base64
import gzip
import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import queries, url_filter, warc


def pages_of(spark, rows):
    rows = [(*r, "host", 3) for r in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, offset int").repartition(3)


# WARC

def fake(n, text="hello"):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(text)}\r\n\r\n{text}\r\n\r\n"


PAYLOADS = [None, "", "<p>é</p>", "<p>é</p>", "WARC/1.0\r\n", "a WARC/1.0\r\nb", fake(77), "x" + fake(78) * 3 + "y",
            "WARC/1.0\r\nContent-Length: 3\r\n\r\n", "\r\n\r\n", "tail WARC/1.0", fake(77), "z" * 200_000, "", "<p>É</p>",
            # lengths that no file has, and lengths beyond the end of this one
            *[f"WARC/1.0\r\nContent-Length: {n}\r\n\r\nx" for n in ("9" * 25, "9" * 18, "9" * 5000, "-1", "1e3", "٣", "")],
            "WARC/1.0\r\nWARC-Record-ID: <urn:page:>\r\nContent-Length: 0\r\n\r\n" * 3]


@pytest.mark.parametrize("records_per_file", [1, 4, 1024])
def test_round_trip(spark, scratch, records_per_file):
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, p) for i, p in enumerate(PAYLOADS)]
    path = f"{scratch}/warc"
    warc.write(warc.records(pages_of(spark, rows)), path, records_per_file)
    got = {int(r.id): r for r in warc.resolved(warc.read(spark, path)).collect()}
    assert len(got) == len(PAYLOADS)
    first = {}
    for i, p in enumerate(PAYLOADS):
        raw = (p or "").encode()
        first.setdefault(raw, i)
        r = got[i]
        assert (r.bytes, r.digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.type, r.refers_to) == (("response", None) if first[raw] == i else ("revisit", str(first[raw])))


def test_splits_of_a_plain_file(spark, scratch):
    """A file cut into many splits, magic lines inside payloads and all."""
    os.makedirs(f"{scratch}/plain")
    payloads = [p or "" for p in PAYLOADS if p != "z" * 200_000] + [fake(i) + "q" * i for i in range(60)]
    with open(f"{scratch}/plain/a.warc.txt", "wb") as f:
        for i, p in enumerate(payloads):
            block = b"HTTP/1.1 200 OK\r\n\r\n" + p.encode()
            f.write(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n"
                    % (i, len(block)) + block + b"\r\n\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = {int(r.id): r for r in warc.read(spark, f"{scratch}/plain").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(payloads)
    assert all(got[i].bytes == len(p.encode()) for i, p in enumerate(payloads))


def test_files_are_warc(spark, scratch):
    warc.write(warc.records(pages_of(spark, [(1, "http://a/", "x")])), f"{scratch}/w")
    name = next(n for n in os.listdir(f"{scratch}/w") if n.endswith(".gz"))
    with gzip.open(f"{scratch}/w/{name}") as f:
        raw = f.read()
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nx\r\n\r\n")


def test_least_bytes_and_no_rows(spark, scratch):
    pages = pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (4, "u", "abc")])
    types = Counter((r.id, r.type) for r in warc.records(pages, least_bytes=3).collect())
    assert types == {(1, "response"): 1, (2, "response"): 1, (3, "response"): 1, (4, "revisit"): 2}
    warc.write(warc.records(pages.limit(0)), f"{scratch}/none")
    assert warc.resolved(warc.read(spark, f"{scratch}/none")).count() == 0


# URL filter

def brute(rows):
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        path = rest[end:]
        return rest[:end].lower(), path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]

    found, hosts, links = [], defaultdict(list), Counter()
    for _, url, html in rows:
        host, path = parts(url)
        fits = [((h + p), v) for (h, p), v in url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        found.append((host, path, rule, verdict))
        if host:
            hosts[host].append(verdict)
            for part in (html or "").split('href="')[1:]:
                target = part.split('"')[0]
                if target.startswith(("http://", "//")):
                    target = target.split("//")[1].split("/")[0].lower()
                    if target != host:
                        links[host, target] += 1

    def rank(edges, seeds):
        start = {h: 1 / len(seeds) for h in seeds}
        now = dict(start)
        for _ in range(300 if edges else 0):
            new = defaultdict(float)
            for (s, d), w in edges.items():
                new[d] += url_filter.DAMPING * now.get(s, 0) * w
            for h, x in start.items():
                new[h] += (1 - url_filter.DAMPING) * x
            now = new
        return now

    out = Counter()
    for (s, _), n in links.items():
        out[s] += n
    edges = {(s, d): n / out[s] for (s, d), n in links.items()}
    into = Counter()
    for (_, d), w in edges.items():
        into[d] += w
    against = {(d, s): w / into[d] for (s, d), w in edges.items()}
    trust = rank(edges, [h for h, v in hosts.items() if v.count("allow") >= 0.5 * len(v)])
    distrust = rank(against, [h for h, v in hosts.items() if v.count("block") >= 0.5 * len(v)])

    def judged(host):
        t, d = trust.get(host, 0), distrust.get(host, 0)
        return "block" if d > 0 and d >= url_filter.THRESHOLD * (t + d) else "allow"

    return [(h, p, r, v or judged(h)) for h, p, r, v in found]


def test_ranks_equal_a_dense_solve(spark):
    """A chain of more than ten hosts into a blocked one, and a cycle."""
    chain = [f"h{i}.com" for i in range(14)]
    links = list(zip(chain, chain[1:] + ["bad.net"], strict=True)) + [("h3.com", "x.com"), ("x.com", "h2.com")]
    rows = [(i, f"http://{s}/", f'<a href="http://{d}/">') for i, (s, d) in enumerate(links)]
    rows += [(98, "http://bad.net/", ""), (99, "http://g.example.net/en/", '<a href="http://x.com/">')]
    links += [("g.example.net", "x.com")]
    hosts = sorted({h for pair in links for h in pair})
    at = {h: i for i, h in enumerate(hosts)}
    forward = np.zeros((len(hosts), len(hosts)))
    for s, d in links:
        forward[at[d], at[s]] += 1
    forward /= np.maximum(forward.sum(0), 1)
    against = forward.T / np.maximum(forward.sum(1), 1e-300)

    def solve(m, seed):
        d = url_filter.DAMPING
        return np.linalg.solve(np.eye(len(hosts)) - d * m, (1 - d) * (np.arange(len(hosts)) == at[seed]))

    trust, distrust = solve(forward, "g.example.net"), solve(against, "bad.net")
    got = {r.host: r for r in url_filter.judged(pages_of(spark, rows)).collect()}
    for h in hosts:
        assert abs(got[h].trust - trust[at[h]]) < 1e-8 and abs(got[h].distrust - distrust[at[h]]) < 1e-8
    assert got["h0.com"].distrust > 0 and got["h0.com"].verdict == "block"


def test_ranks_that_do_not_settle_fail(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(12)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, share double")
    with pytest.raises(RuntimeError, match="settle"):
        url_filter.propagated(edges, seeds, most_rounds=10)


def test_link_graph(spark):
    rows = [(0, "http://bad.net/x", ""), (1, "http://a.com/x", '<a href="http://bad.net/">'),
            (2, "http://b.com/", '<a href="//A.com/y"><a href="/own">'), (3, "http://good.example.net/en/1", '<a href="http://c.com/">'),
            (4, "http://c.com", '<a href="http://bad.net/"><a href="http://b.com/">'), (5, None, "x"), (6, "no scheme", None),
            (7, "HTTP://Example.com/de/?q#f", ""), (8, "http://x.org/fr/a", '<a href="http://c.com/z">'),
            (9, "http://lonely.com?x://y/", ""), (10, "a://b://c/d", ""), (11, "http://bad.net", ""), (0, "http://bad.net/x", ""),
            (12, "http://d.com/", '<a href="http://bad.net/">')]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judged(pages_of(spark, rows)).collect())
    want = sorted((r[0], h, p, x or "", v) for r, (h, p, x, v) in zip(rows, brute(rows), strict=True))
    assert got == want
    assert {v for *_, v in want} == {"allow", "block"}
    assert ("d.com", "block") in {(h, v) for _, h, _, _, v in want}
    assert url_filter.judged(pages_of(spark, rows).limit(0)).count() == 0


def test_sql_ranks_equal_the_operator_on_linked_graphs(spark):
    """The SQL iterates as long as the operator: a chain of fifteen hosts to a
    blocked one, and random links."""
    rnd = random.Random(8)
    rows = [(i, f"http://h{i}.com/x", f'<a href="http://{"bad.net" if i == 14 else f"h{i + 1}.com"}/">') for i in range(15)]
    rows += [(100, "http://bad.net/q", ""), (101, "http://a.org/fr/x", '<a href="http://h3.com/"> <a href="//h200.com/x">'),
             (102, "http://h200.com/", None), (103, None, "x")]
    hosts = ["s.net", "t.net", "u.org", "v.org", *(f"k{i}.com" for i in range(30))]
    rows += [(200 + i, f"http://{h}/fr/", " ".join(f'<a href="//{x}/">' for x in rnd.sample(hosts, 2)))
             for i, h in enumerate(hosts)]
    got = sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in url_filter.judged(pages_of(spark, rows)).collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = sorted((i, h, rule or "", v) for i, h, _, rule, v in con.execute(queries.OP4_SQL).fetchall())
    assert got == want
    assert {r[3] for r in got if r[1].startswith("k")} == {"allow", "block"}


def test_rules_are_bounded(spark):
    with pytest.raises(ValueError):
        url_filter.judged(pages_of(spark, [(1, "u", "")]), rules=[((f"h{i}", "/"), "block") for i in range(1001)])
