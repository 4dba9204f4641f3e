"""The trie of rebuilt conversations against brute force."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from tessera.llm import prefix_trie


def brute(rows, family=5, lent=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % lent
        base = c - (c % family if c >= 0 else -(-c % family))
        seqs[c] = own.get(base, [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted((m[0], len(k), -1 if not k else nodes[k[:-1]][0], len(m), children[k], leaves[k], saved[k],
                   sha256(",".join(str(c) for c in m if len(seqs[c]) == len(k)).encode()).hexdigest())
                  for k, m in nodes.items())


def found(spark, rows, partitions=4, **options):
    df = spark.createDataFrame([(*r, "k", 3, 1) for r in rows], "conv_id long, turn long, role string, text string, "
                                                                "key string, n long, pos int").repartition(partitions)
    out = prefix_trie.trie(df, **options).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def shared_prefixes(seed, convs, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, "user" if t % 2 else "assistant", "turn é " * rng.randrange(1, words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("depth, shard_turns", [(64, 1 << 18), (64, 1), (4, 7)])
def test_equals_brute_force(spark, depth, shard_turns):
    rows = shared_prefixes(depth, 60, 14)
    assert found(spark, rows, depth=depth, shard_turns=shard_turns) == brute(rows)


def test_equal_and_long_conversations(spark):
    rows = [(c, t, "user", f"line {t}") for c in range(0, 200, 5) for t in range(3)]  # forty copies
    rows += [(c, t, "user", f"long {t}" if t < 18 else f"end {c % 2} {t}") for c in (5000, 5005, 5010, 5015) for t in range(23)]
    rows += [(7005, t, "user", f"alone {t}") for t in range(40)]
    assert found(spark, rows, depth=8, shard_turns=10, piece_ids=3) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "a", "b"), (1, 3, "a", "b"), (1, 3, "a", "b"), (1, 1, "", ""), (None, 1, "u", "x"),
            (None, None, None, None), (-7, 0, "u", "minus"), (-5, 0, "u", "base"), (-5, 2, "u", "😀" * 5000),
            (11, 1, "u", "no base"), (12, 1, "u", "no base"), (13, 5, "a", "12:x"), (13, 4, "a1", "2:x"),
            (10 ** 15, 1, "u", "far")]
    assert found(spark, rows) == brute(rows)
    turnless = [(c, 0, "u", "one") for c in range(1, 5)]
    assert found(spark, turnless) == brute(turnless)
    assert found(spark, []) == []
