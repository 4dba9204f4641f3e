"""The trie of all prefixes of rebuilt conversations.

Turns are encoded by a dictionary: each distinct (role, text) gets a number.
Equal conversations are one sequence of numbers, with its members counted.
Sequences are sorted and range-partitioned, and each range is cut into shards
of bounded size.  A shard's sequences go into a ternary search tree, the
median first and then the medians of both halves, so that it is balanced; an
iterative traversal from the last node to the first adds up members, leaves
and savings.  Only the nodes on the paths of a shard's first and last sequence
can belong to other shards too: these boundary nodes are merged by path, and
what lies below them is added along their ancestors.

Sequences are taken ``depth`` turns at a time.  What continues below one node
is a group of the next round, whose totals flow back up.  A sequence that
continues alone branches no more: its nodes are rows computed in place.  So a
task holds one shard and ``depth`` turns of a sequence at most, however long a
conversation is and however many are equal or share their first turns.

Defined results: turns are ordered by number, null first, and turns of one
number by the SHA-256 of role and text; a null role or text is empty; a null
conv_id is no conversation; repeated rows are repeated turns; a conversation
without rebuilt turns is a member of the root alone; an empty table gives no
rows, not even a root; extra columns are ignored.

The digest of a node's ends reads their ids in one sequence by definition of
SHA-256; ids arrive packed and are fed to it piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.operators.ranking import global_rank, prefix_aggregate

from .common import looked_up, written

FAMILY = 5  # conv_id - conv_id % FAMILY lends its first turns
LENT = 9  # crc32 of the conv_id modulo LENT is how many
DEPTH = 64
SHARD_TURNS = 1 << 18
PIECE_IDS = 1 << 14
CHUNK = 1 << 10
SALTS = 64


def _with(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (conv_id, pos, ...) with the columns of their conversation in
    ``per`` (conv_id, n, ...), where pos < n.  A key is CHUNK turns of a
    conversation, so that a long one is no hot key."""
    per = per.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.floor((F.col("n") - 1) / CHUNK), F.lit(0).cast("long")))))
    return rows.withColumn("_chunk", F.floor(F.col("pos") / CHUNK)).join(per, ["conv_id", "_chunk"]).drop("_chunk")


def rebuilt(conversations: DataFrame, family: int = FAMILY, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, bytes) of every turn of the rebuilt
    conversations, and (conv_id, n) of all conversations with their lengths."""
    c = conversations
    role, text = F.coalesce(c["role"], F.lit("")), F.coalesce(c["text"], F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = c.where(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    ordered = written(global_rank(turns, [F.col("turn").asc_nulls_first(), "digest"], ["conv_id"], rank_col="rank")
                      .select("conv_id", (F.col("rank") - 1).alias("pos"), "digest", "bytes"), "ordered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lent
    convs = ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = written(convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family), "convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn(
        "lent", F.least("h", F.coalesce("base_turns", F.lit(0).cast("long"))))
    heads = ordered.where(F.col("pos") < lent - 1).withColumnRenamed("conv_id", "base")
    borrowed = (convs.where("lent > 0").join(heads, "base").where("pos < lent")
                .select("conv_id", "pos", "digest", "bytes"))
    own = (_with(ordered, convs.select("conv_id", F.col("own").alias("n"), "h", "lent")).where("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "bytes"))
    rows = written(borrowed.unionByName(own), "rebuilt")
    lengths = convs.select("conv_id", (F.col("lent") + F.greatest(
        F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("n"))
    return rows, lengths


# equal conversations

PIECE = "a long, b long, n long, first long, ids binary, count long"


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, n, conv_id): the ids of each run of equal
    (a, b, n), comma-joined, at most ``most`` to a piece."""
    for batch in batches:
        a, b, n, ids = (batch.column(k).to_numpy() for k in range(4))
        cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(n) != 0)) + 1
        cuts = np.union1d(np.r_[0, cuts], np.arange(0, len(a), most)).astype(np.int64)
        names = ids.astype(str).tolist()
        ends = [*cuts[1:].tolist(), len(names)]
        if len(a):
            yield pa.record_batch(
                [pa.array(x) for x in (a[cuts], b[cuts], n[cuts], ids[cuts])]
                + [pa.array([",".join(names[i:j]).encode() for i, j in zip(cuts.tolist(), ends, strict=True)], pa.binary()),
                   pa.array(np.array(ends) - cuts)], names=[c.split()[0] for c in PIECE.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (a, b, n, first): per (a, b, n) its least id, size
    and the digest of its ids."""
    now, first, count, state, n = None, 0, 0, None, 0
    names = ["conv_id", "n", "weight", "ends_sha256"]
    for batch in batches:
        out = []
        columns = [batch.column(k).to_numpy().tolist() for k in (0, 1, 2, 3, 5)]
        for i, (a, b, length, least, size) in enumerate(zip(*columns, strict=True)):
            if (a, b, length) != now:
                if now is not None:
                    out.append((first, n, count, state.hexdigest()))
                now, first, n, count, state = (a, b, length), least, length, 0, sha256()
            else:
                state.update(b",")
            state.update(batch.column(4)[i].as_py())
            count += size
        if out:
            yield pa.record_batch([pa.array(list(x)) for x in zip(*out, strict=True)], names=names)
    if now is not None:
        yield pa.record_batch([pa.array([x]) for x in (first, n, count, state.hexdigest())], names=names)


def distinct_sequences(rows: DataFrame, lengths: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """One conversation (the least conv_id) of each group of equal ones:
    conv_id, n, its ``weight`` in members, and their ``ends_sha256``.
    Sequences are equal if 128 bits over the places and digests of all
    their turns are."""
    lane = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "digest")).alias(c) for k, c in ((1, "a"), (2, "b"))]
    prints = lengths.join(rows.groupBy("conv_id").agg(*lane), "conv_id", "left").select(
        F.coalesce("a", F.lit(0).cast("long")).alias("a"), F.coalesce("b", F.lit(0).cast("long")).alias("b"), "n",
        "conv_id")
    key = ["a", "b", "n"]
    pieces = (prints.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(lambda it: _pieces(it, piece_ids), PIECE))
    return written(pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(
        _digests, "conv_id long, n long, weight long, ends_sha256 string"), "sequences")


def encoded(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, id, bytes): turns by their numbers in the dictionary of
    distinct turns."""
    counts = written(global_rank(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("turns")), ["digest"],
                                 rank_col="id"), "dictionary")
    return written(looked_up(rows, counts, "digest", "turns", ["id"]).select("conv_id", "pos", "id", "bytes"), "encoded")


# one shard

class Tree:
    """A ternary search tree over sequences of numbers.  Node 0 stands above
    all; a node's parent in the trie comes before it."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down = [0], [-1], [-1], [-1]
        self.parent, self.bytes = [-1], [0]

    def _new(self, symbol: int, parent: int, n_bytes: int) -> int:
        for column, x in ((self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1),
                          (self.parent, parent), (self.bytes, n_bytes)):
            column.append(x)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int], sizes: list[int]) -> list[int]:
        """The nodes of the sequence, added where they are new."""
        symbol, low, high, down = self.symbol, self.low, self.high, self.down
        at, path = 0, []
        for s, n_bytes in zip(sequence, sizes, strict=True):
            t = down[at]
            if t < 0:
                t = down[at] = self._new(s, at, n_bytes)
            while symbol[t] != s:
                side = low if s < symbol[t] else high
                if side[t] < 0:
                    side[t] = self._new(s, at, n_bytes)
                t = side[t]
            path.append(t)
            at = t
        return path


def balanced(n: int) -> Iterator[int]:
    """0 to n - 1, each range's median before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(middle + 1, b), (a, middle)]


NODE = ("shard long, slot long, parent_slot long, grp long, level int, conv_id long, parent_conv_id long, "
        "n_convs long, bytes long, n_children long, n_leaves long, saved_tokens long, ends long, "
        "key binary, parent_key binary, ancestors array<binary>")
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
SEQUENCE = ["grp", "ids", "sizes", "conv_id", "weight", "ends", "children", "leaves", "saved"]


def _traversed(rows: list[tuple], shard: int) -> list[tuple]:
    """NODE rows of a shard's sequences (SEQUENCE tuples, sorted).  Those of
    boundary nodes have a key and lack what boundary children add."""
    tree = Tree()
    ends_at: dict[int, list[tuple]] = {}
    paths = {}
    for i in balanced(len(rows)):
        grp, ids, sizes, *_ = rows[i]
        path = tree.insert([grp, *ids], [0, *sizes])
        ends_at.setdefault(path[-1], []).append(rows[i])
        if i in (0, len(rows) - 1):
            paths[i] = path
    n, parent = len(tree.symbol), tree.parent
    keys: dict[int, tuple[bytes, list[bytes]]] = {}
    slots: dict[int, int] = {}
    for path in paths.values():
        key, above = b"", []
        for node in path:
            key = blake2b(key + tree.symbol[node].to_bytes(8, "little", signed=True), digest_size=16).digest()
            above = [*above, key]
            keys[node] = (key, above)
            slots.setdefault(node, len(slots))
    convs, weight, ends = [None] * n, [0] * n, [None] * n
    children, leaves, saved, level, grp = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n
    for node, found in ends_at.items():
        for _, _, _, conv, w, end, deep_children, deep_leaves, deep_saved in found:
            convs[node] = conv if convs[node] is None else min(conv, convs[node])
            weight[node] += w
            ends[node] = end if end is not None else ends[node]
            children[node] += deep_children or 0
            leaves[node] += deep_leaves or 0
            saved[node] += deep_saved or 0
    for node in range(1, n):  # from the top down
        level[node] = level[parent[node]] + 1
        grp[node] = tree.symbol[node] if not level[node] else grp[parent[node]]
    for node in range(n - 1, 0, -1):  # from the bottom up
        up = parent[node]
        weight[up] += weight[node]
        convs[up] = convs[node] if convs[up] is None else min(convs[up], convs[node])
        if node not in keys:
            if not children[node]:
                leaves[node] = 1
            saved[node] += (weight[node] - 1) * tree.bytes[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    out = []
    for node in range(1, n):
        up, (key, above) = parent[node], keys.get(node, (None, None))
        final_parent = None if up in slots or not up else convs[up]
        out.append((shard, slots.get(node), slots.get(up), grp[node], level[node], convs[node], final_parent, weight[node],
                    tree.bytes[node], children[node], leaves[node], saved[node], ends[node], key,
                    above[-2] if above and len(above) > 1 else None, above))
    return out


def _shards(batches: Iterator[pa.RecordBatch], most_turns: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, ids), in shards between different sequences."""
    types = [pa.field(c.split()[0], t) for c, t in zip(
        NODE.split(", "), [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 8 + [pa.binary()] * 2
        + [pa.list_(pa.binary())], strict=True)]
    first, made, held, turns = TaskContext.get().partitionId() << 33, 0, [], 0

    def done():
        found = _traversed(held, first + made)
        for i in range(0, len(found), 10_000):
            columns = zip(*found[i:i + 10_000], strict=True)
            yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(columns, types, strict=True)],
                                  schema=pa.schema(types))

    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(k)[i].as_py() for k in range(len(SEQUENCE)))
            if turns >= most_turns and row[:2] != held[-1][:2]:
                yield from done()
                made, held, turns = made + 1, [], 0
            held.append(row)
            turns += len(row[1]) + 1
    if held:
        yield from done()


def _merged(found: DataFrame) -> DataFrame:
    """The final nodes of one round: grp, level, conv_id, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends."""
    edge = written(found.where("key is not null"), "boundary")
    merged = edge.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"), F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"),
        F.max("grp").alias("grp"), F.max("level").alias("level"), F.max("ancestors").alias("ancestors"))
    kids = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids")).where("key is not null")
    merged = written(merged.join(kids, "key", "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("kids", F.lit(0))), "merged")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    totals = (merged.select(F.explode("ancestors").alias("key"), (F.col("inner_leaves") + leaf).alias("leaves"),
                            (F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
              .groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    result = ["grp", "level", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    boundary = merged.join(totals, "key").join(names, "parent_key", "left").select(*result)
    inner = found.where("key is null")
    above = edge.select("shard", F.col("slot").alias("parent_slot"), "key").join(
        merged.select("key", F.col("conv_id").alias("above")), "key").drop("key")
    hung = (inner.where("parent_slot is not null").join(above, ["shard", "parent_slot"])
            .withColumn("parent_conv_id", F.col("above")))
    return written(boundary.unionByName(hung.select(*result)).unionByName(
        inner.where("parent_slot is null").select(*result)), "nodes")


# rounds

def _tails(rows: DataFrame, alone: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Nodes from depth ``start`` + 1 on of sequences that continue alone
    (conv_id, n, weight, above), and what their rest saves (conv_id, rest)."""
    rest = _with(rows.where(F.col("pos") >= start), alone)
    many = prefix_aggregate(rest.where("weight > 1"), "bytes", [F.desc("pos")], ["conv_id"], "sum", "after",
                            exclusive=False)
    rest = rest.where("weight = 1").withColumn("after", F.lit(0).cast("long")).unionByName(many.select(*rest.columns, "after"))
    last = F.col("pos") + 1 == F.col("n")
    nodes = written(rest.select(
        (F.col("pos") + 1).alias("depth"), "conv_id",
        F.when(F.col("pos") == start, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * F.col("after")).alias("saved_tokens"),
        F.when(last, F.col("conv_id")).alias("ends")), "tails")
    return nodes, nodes.where(F.col("depth") == start + 1).select("conv_id", F.col("saved_tokens").alias("rest"))


def trie(conversations: DataFrame, family: int = FAMILY, lent: int = LENT, depth: int = DEPTH,
         shard_turns: int = SHARD_TURNS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, lengths = rebuilt(conversations, family, lent)
    sequences = distinct_sequences(rows, lengths, piece_ids)
    rows = encoded(_with(rows, sequences.select("conv_id", "n")).drop("n"))
    least = sequences.agg(F.min("conv_id")).first()[0]
    active = sequences.select("conv_id", "n", "weight", F.lit(least).cast("long").alias("grp"))
    levels, nodes = [], []
    # down: cut the sequences, and find those that continue together
    while True:
        start = depth * len(levels)
        cut = _with(rows.where(F.col("pos").between(start, start + depth - 1)), active.select("conv_id", "n")).groupBy(
            "conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("turns"))
        none = F.expr("cast(array() as array<long>)")
        cut = written(active.join(cut, "conv_id", "left").select(
            "conv_id", "n", "weight", "grp", F.coalesce(F.col("turns.id"), none).alias("ids"),
            F.coalesce(F.col("turns.bytes"), none).alias("sizes")), "cut")
        on = F.col("n") > start + depth
        # (grp, ids) may be shared by many: reduced in salted parts first, and met by them again
        salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
        parts = written(cut.where(F.col("n") >= start + depth).withColumn("salt", salt).groupBy("grp", "ids", "salt").agg(
            F.min("conv_id").alias("least"), F.sum(on.cast("long")).alias("going"), F.max("sizes").alias("sizes"),
            F.sum(F.when(on, F.col("weight"))).alias("weight"), F.min(F.when(on, F.col("conv_id"))).alias("conv_id")),
            "parts")
        below = written(parts.groupBy("grp", "ids").agg(
            F.min("least").alias("next"), F.sum("going").alias("going"), F.max("sizes").alias("sizes"),
            F.sum("weight").alias("weight"), F.min("conv_id").alias("conv_id")).where("going > 0"), "below")
        names = parts.where("going > 0").select("grp", "ids", "salt").join(
            below.select("grp", "ids", "next", "going"), ["grp", "ids"])
        going = written(cut.where(on).withColumn("salt", salt).join(names, ["grp", "ids", "salt"])
                        .select("conv_id", "n", "weight", "next", "going"), "going")
        tails, rest = _tails(rows, going.where("going = 1").select("conv_id", "n", "weight", F.col("next").alias("above")),
                             start + depth)
        nodes.append(tails)
        levels.append((start, cut.where(~on), below, rest))
        active = going.where("going > 1").select("conv_id", "n", "weight", F.col("next").alias("grp"))
        if active.isEmpty():
            break
    # up: a tree per shard, with what the deeper round found below its deepest nodes
    totals = None
    for start, ending, below, rest in reversed(levels):
        zero = F.lit(0).cast("long")
        deep = below.join(rest, "conv_id", "left").withColumn("alone", F.col("going") == 1)
        if totals is None:
            deep = deep.select("*", zero.alias("c"), zero.alias("l"), zero.alias("s"))
        else:
            deep = deep.join(totals, "next", "left")
        deep = deep.select("grp", "ids", "sizes", "conv_id", "weight", F.lit(None).cast("long").alias("ends"),
                           F.when(F.col("alone"), 1).otherwise(F.col("c")).cast("long").alias("children"),
                           F.when(F.col("alone"), 1).otherwise(F.col("l")).cast("long").alias("leaves"),
                           F.when(F.col("alone"), F.coalesce("rest", zero)).otherwise(F.col("s")).alias("saved"))
        ending = ending.select("grp", "ids", "sizes", "conv_id", "weight", F.col("conv_id").alias("ends"),
                               zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
        found = _merged(written(
            ending.unionByName(deep).repartitionByRange("grp", "ids").sortWithinPartitions("grp", "ids")
            .select(*SEQUENCE).mapInArrow(lambda it: _shards(it, shard_turns), NODE), "shards"))
        if start:
            totals = found.where("level = 0").select(F.col("grp").alias("next"), F.col("n_children").alias("c"),
                                                     F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
            # a group's top node is a node of the round above; its own name is the parent's
            found = found.where("level > 0").withColumn("parent_conv_id", F.when(
                F.col("level") == 1, F.col("grp")).otherwise(F.col("parent_conv_id")))
        nodes.append(found.select((F.col("level") + start).cast("long").alias("depth"), *tails.columns[1:]))
    found = reduce(DataFrame.unionByName, nodes)
    ended = found.where("ends is not null").join(
        sequences.select(F.col("conv_id").alias("ends"), "ends_sha256"), "ends")
    return ended.drop("ends").unionByName(found.where("ends is null").drop("ends").withColumn(
        "ends_sha256", F.sha2(F.lit(""), 256)))
