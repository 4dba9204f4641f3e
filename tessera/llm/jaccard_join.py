"""N-gram Jaccard self-join by grouped prefixes.

A document is the set of its five-word shingles, as 64-bit hashes.  Two sets
with a similarity of ``percent`` or more share one of their first tokens in
any fixed order of all tokens; here the order is by hash, with common tokens
at the end, which keeps common lines and passages out of the prefixes.  Common
are the tokens of those of a fixed number of hash buckets that hold more than
chance explains, counted over all documents.  (Which tokens those are changes
the work, never the result.)

Sets with identical prefixes and size are one group.  Group pairs come from
tokens that several groups share, and are filtered by size and by what the
positions of the token leave possible.  Pairs that pass are expanded to their
members and verified on the whole texts.

Links are found in rounds so that a large cluster costs no pair of its members.
In the first star round each token's groups meet the head of one of them, the
pivot, which is done with that if it has no other member; what the links so far
leave in different components meets a few new pivots in the next round.  When that
neither halves what is left nor links much of it, all groups of a token that
are still apart meet each other, at the first token that they share.  Pairs
inside one component need no check: they can add no reachability.  Every set has a parity sketch, 1,024 bits of
which each token flips one: two sets differ in at least as many tokens as their
sketches differ in bits, so pairs beyond the bound never become rows, and no
pair is dropped that could be a link.  That gives components; the number of
links needs all pairs, and is counted from all of them (``near_duplicates``).

Exact copies are one set from the start.  Defined results: a null text is
empty; a set without words is linked with nothing; fewer words than a shingle
are one shingle; a row with a null doc_id links like any other, but names a
component only if no row of it has an id (then it is null); repeated rows are
copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import few, located, looked_up, packed, unpacked, written
from .components import components
from .hashing import Hashed, word_hashes

WORDS = 5
PERCENT = 80
#: Hash buckets of the token counts, and the slices in which they are added up.
BUCKETS = 1 << 24
SLICES = 1 << 10
#: Bits of a parity sketch.
SKETCH_BITS = 1 << 10
#: Bits of the sketch that rides on a token's row: the parities of parities of a sketch.
ROW_BITS = 1 << 9
#: A list of rows up to this length is broadcast; a longer one is joined by shuffling.
BROADCAST_IDS = 500_000
#: Star rounds at most; what they leave apart is compared in full.
STARS = 12
#: Pivots of a token in a star round after the first.
PIVOTS = 4
#: A star round is worth another if it finds a link for so many of the rows left.
WORTH = 256
#: Tokens ahead of a row's own that are searched for one that a pair shares.
AHEAD = 8
SLICE_BYTES = 1 << 20

LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = np.frombuffer(b" ".join(texts).translate(LOWERED), np.uint8)
    inner = ~BLANK[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inner, False].astype(np.int8)))
    words = word_hashes(raw, edge[::2], edge[1::2])
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(edge[::2], ends)
    hashed = Hashed(words)
    shingles = hashed.windows(size)
    out, start = [], 0
    for end in upto:
        n = end - start
        if n >= size:
            out.append(np.unique(shingles[start:end - size + 1]))
        elif n:
            out.append(hashed.of(np.array([start]), np.array([end])))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def node_of(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch, computed in slices."""
    texts, held, out, start = batch.column(column).cast(pa.binary()), 0, [], 0
    for i in range(batch.num_rows):
        out.append(texts[i].as_py() or b"")
        held += len(out[-1])
        if held >= SLICE_BYTES or i == batch.num_rows - 1:
            yield from enumerate(shingle_sets(out, size), start)
            out, held, start = [], 0, i + 1


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.int64)


LOCATOR = ["at_file", "at_row"]
SKETCH = [*LOCATOR, "doc_id", "n", "node", "slice", "counts"]


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row per document; at the end of the task, its token counts by bucket
    in slices.  Equal sets of one batch count once."""
    counts, ids = np.zeros(BUCKETS, np.uint8), None
    for batch in batches:
        sizes, nodes, held = [], [], {}
        for _, tokens in _sets(batch, 3, size):
            sizes.append(len(tokens))
            nodes.append(node_of(tokens))
            if nodes[-1] not in held:
                held[nodes[-1]] = True
                found, times = np.unique(bucket_of(tokens), return_counts=True)
                counts[found] = np.minimum(counts[found] + times, 255)
        ids = batch.column(2).type
        none = pa.nulls(batch.num_rows, pa.int32())
        yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), none,
                               pa.nulls(batch.num_rows, pa.binary())], names=SKETCH)
    if ids is not None:
        parts = [compress(c.tobytes(), 1) for c in counts.reshape(SLICES, -1)]
        del counts
        none = pa.nulls(SLICES, pa.int64())
        yield pa.record_batch([none, none, pa.nulls(SLICES, ids), none, pa.nulls(SLICES, pa.binary()),
                               pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())],
                              names=SKETCH)


def _common_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice, a bit for each bucket that holds more than chance explains.
    Rows come sorted by slice."""
    now, total = None, None

    def done():
        mean = total.mean()
        return pa.record_batch([pa.array([now], pa.int32()), pa.array(
            [np.packbits(total > mean + 3 * np.sqrt(mean) + 2).tobytes()], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        for which, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if which != now:
                if now is not None:
                    yield done()
                now, total = which, np.zeros(BUCKETS // SLICES, np.int64)
            total += np.frombuffer(decompress(counts), np.uint8)
    if now is not None:
        yield done()


def parities(tokens: np.ndarray) -> bytes:
    odd = np.bincount((tokens >> np.uint64(32)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, common) -> Iterator[pa.RecordBatch]:
    last = np.frombuffer(common.value, np.uint8)
    longs = pa.list_(pa.int64())
    for batch in batches:
        done, nodes, sizes, groups, prefixes, sketches = set(), [], [], [], [], []
        for _, tokens in _sets(batch, 0, size):
            node, n = node_of(tokens), len(tokens)
            if not n or node in done:
                continue
            done.add(node)
            at = bucket_of(tokens)
            late = (last[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            prefix = np.concatenate([tokens[~late], tokens[late]])[:prefix_length(n, percent)]
            nodes.append(node)
            sizes.append(n)
            groups.append(int.from_bytes(node_of(prefix)[:8], "little", signed=True))
            prefixes.append(prefix.view(np.int64))
            sketches.append(np.frombuffer(parities(tokens), np.int64))
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(groups, pa.int64()), pa.array(sizes, pa.int64()),
                               pa.array(prefixes, longs), pa.array(sketches, longs)], names=PREFIX_COLUMNS)


PREFIX = "node binary, grp long, n long, prefix array<long>, sketch array<long>"
PREFIX_COLUMNS = [c.split()[0] for c in PREFIX.split(", ")]


def _verified(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for (_, x), (_, y) in zip(_sets(batch, 2, size), _sets(batch, 3, size), strict=True):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            same.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))


def _possible(percent: int):
    """Whether groups x and y can be similar if the token is their first common one."""
    need = f"ceil((x.n + y.n) * {percent} / {100 + percent}D)"
    return F.expr(f"1 + least(x.n - x.pos - 1, y.n - y.pos - 1) >= {need} "
                  f"and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")


def _near(percent: int, n: str, sketch: str, n2: str, sketch2: str, bits: int = SKETCH_BITS):
    """Whether two sets can be similar: of s tokens in all, similar ones differ
    in (100 - percent) / (100 + percent) * s at most, and in no fewer than
    their sketches do.  A null sketch says nothing."""
    apart = " + ".join(f"bit_count({sketch}[{k}] ^ {sketch2}[{k}])" for k in range(bits // 64))
    return F.expr(f"coalesce({100 + percent} * ({apart}) <= {100 - percent} * ({n} + {n2}), true)")


class _Join:
    """``docs`` is located: at_file, at_row, doc_id and text."""

    def __init__(self, docs: DataFrame, size: int, percent: int, broadcast_ids: int):
        self.docs = docs.select(*LOCATOR, "doc_id", "text")
        self.size, self.percent, self.broadcast_ids = size, percent, broadcast_ids
        spark = docs.sparkSession
        doc_id = self.docs.schema["doc_id"].dataType.simpleString()
        sketch = written(self.docs.mapInArrow(
            lambda it: _sketches(it, size),
            f"at_file long, at_row long, doc_id {doc_id}, n long, node binary, slice int, counts binary"), "sketch")
        self.sketch = sketch.where("slice is null").select(*LOCATOR, "doc_id", "n", "node")
        common = (sketch.where("slice is not null").select("slice", "counts").repartition("slice")
                  .sortWithinPartitions("slice").mapInArrow(_common_bits, "slice int, bits binary").toArrow())
        bits = dict(zip(common["slice"].to_pylist(), common["bits"].to_pylist(), strict=True))  # BUCKETS / 8 bytes
        none = bytes(BUCKETS // SLICES // 8)
        last = spark.sparkContext.broadcast(b"".join(bits.get(k, none) for k in range(SLICES)))
        self.prefixes = written(self.docs.select("text").mapInArrow(
            lambda it: _prefixes(it, size, percent, last), PREFIX), "prefixes")
        # a set's rows, its smallest doc_id, and one row to read its text from
        self.nodes = written(self.sketch.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"),
            F.min(F.struct(*LOCATOR)).alias("at")).select("node", "doc_id", "rows", "at.*"), "nodes")

    def tokens(self) -> DataFrame:
        """token, grp, n, pos, the token's number of groups and one of them by
        hash, its pivot, of the tokens that several groups share."""
        rows = self.prefixes.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
        rows = rows.repartition("token").dropDuplicates(["token", "grp", "n"])
        own = Window.partitionBy("token")
        rows = rows.withColumn("groups", F.count(F.lit(1)).over(own)).withColumn(
            "pivot", F.min(F.struct("grp", "n", "pos")).over(own))
        return written(rows.where("groups > 1").drop("groups"), "tokens")

    def members(self) -> DataFrame:
        """grp, n, node and sketch of each set."""
        return written(self.prefixes.drop("prefix").dropDuplicates(["node"]), "members")

    def small(self, ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= self.broadcast_ids else ids

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those node pairs (a, b) that are similar, by their whole texts."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a != b").distinct(), "pairs")
        self.compared = pairs.count()
        wanted = few(pairs.select(F.explode(F.array("a", "b")).alias("node")), self.compared).distinct()
        wanted = written(wanted.join(self.nodes, "node").select("node", *LOCATOR), "wanted")
        size, percent = self.size, self.percent
        texts = written(self.docs.join(self.small(wanted), LOCATOR).select("node", "text"), "texts")
        both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
                .select("a", "b", "text_a", "text_b"))
        return written(both.mapInArrow(lambda it: _verified(it, size, percent), "a binary, b binary"), "links")

    def expanded(self, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """Node pairs (a, b) of group pairs (grp, n, grp2, n2) that can be
        similar: ``left`` and ``right`` are members (grp, n, node, sketch and
        perhaps component) of the two groups."""
        x = left.withColumnsRenamed({"node": "a", "sketch": "sketch_a", "component": "c"})
        y = right.withColumnsRenamed({"grp": "grp2", "n": "n2", "node": "b", "sketch": "sketch_b", "component": "c2"})
        on = F.expr("p.grp2 = y.grp2 and p.n2 = y.n2") & _near(self.percent, "p.n", "sketch_a", "y.n2", "sketch_b")
        if "component" in left.columns:
            on = on & F.expr("c != c2")
        return pairs.join(x, ["grp", "n"]).alias("p").join(y.alias("y"), on).select("a", "b")

    def all_links(self) -> DataFrame:
        """Every similar pair of sets (a, b), once."""
        members, tokens = self.members(), self.tokens()
        x, y = tokens.alias("x"), tokens.alias("y")
        pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & F.expr(
            "(x.grp < y.grp or x.grp = y.grp and x.n < y.n)") & _possible(self.percent))
                 .select("x.grp", "x.n", F.col("y.grp").alias("grp2"), F.col("y.n").alias("n2")).distinct())
        across = self.expanded(pairs, members, members)
        own = members.select("grp", "n", F.col("grp").alias("grp2"), F.col("n").alias("n2")).distinct()
        return self.links(across.unionByName(self.expanded(own, members, members).where("a < b")))

    def stars(self, pairs: DataFrame, members: DataFrame, heads: DataFrame) -> DataFrame:
        """Links of the heads of the left groups with the members of the right ones."""
        return self.links(self.expanded(pairs.distinct(), heads, members))

    def merged(self, own: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``own`` (grp, n, node, component) with what ``links`` (a, b) join in
        one component, and what changed (component, now).  Only the components
        that the links touch are worked on."""
        links = self.small(links.select("a", "b"))
        at = own.select(F.col("node").alias("a"), F.col("component").alias("x"))
        x = written(at.join(links, "a").select("x", F.col("b").alias("node")), "ends")
        ends = own.select("node", F.col("component").alias("b")).join(self.small(x), "node")
        moves = components(ends.select(F.col("x").alias("a"), "b"))
        moves = written(moves.where("node != component").select(
            F.col("node").alias("component"), F.col("component").alias("now")), "moves")
        own = own.join(self.small(moves), "component", "left").select(
            "grp", "n", "node", F.coalesce("now", "component").alias("component"))
        return written(own, "of"), moves

    def placed(self, rows: DataFrame, turn: int) -> DataFrame:
        """``rows`` (token, grp, n, pos, single: whether the group has one
        member, low and high: the least and the greatest component in it) of
        tokens whose groups are not all in one component, with the token's
        pivots of this turn and whether the group is one (``met``).  A pivot
        with one member meets all groups of its token in its turn, and its row
        is not needed after that."""
        own = Window.partitionBy("token")
        group = ["grp", "n", "pos", "low", "high"]
        keys = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "grp", "n").alias("h"), *group)).over(own)
                for k in range(PIVOTS)]
        # one shuffle by token
        rows = rows.select("token", *group, "single").withColumns(
            {"l": F.min("low").over(own), "h": F.max("high").over(own), "pivots": F.array_distinct(F.array(*keys))})
        met = F.exists("pivots", lambda p: (p["grp"] == F.col("grp")) & (p["n"] == F.col("n")))
        return written(rows.where("l != h").drop("l", "h").withColumn("met", met), "placed")

    def followed(self, rows: DataFrame, moves: DataFrame, shared: DataFrame) -> DataFrame:
        """``rows`` after ``moves`` (component, now), without the pivots that
        are done; ``shared`` has low and high of the groups (grp, n) of several
        members."""
        rows = rows.where("not (single and met)").select("token", "grp", "n", "pos", "single", F.col("low").alias("component"))
        rows = rows.join(self.small(moves), "component", "left").join(self.small(shared), ["grp", "n"], "left")
        one = F.coalesce("now", "component")
        return rows.select("token", "grp", "n", "pos", "single", F.coalesce("low", one).alias("low"),
                           F.coalesce("high", one).alias("high"))

    def meetings(self, rows: DataFrame) -> DataFrame:
        """Group pairs (grp, n, grp2, n2) of ``rows`` (token, grp, n, pos, low,
        high, pivot and sketch) that share a token, are apart and can be similar.
        A pair meets at its first token in these rows: at a later one some
        token ahead is in both groups.  (Of those only the last few are
        searched, so a pair may come more than once.)"""
        ahead = Window.partitionBy("grp", "n").orderBy("pos").rowsBetween(-AHEAD, -1)
        rows = written(rows.withColumn("ahead", F.collect_list("token").over(ahead)).withColumn("settled", F.expr(
            "low = high and pivot.low = pivot.high and low = pivot.low")).drop("pivot"), "apart")
        x, y = rows.where("not settled").alias("x"), rows.alias("y")
        apart = F.expr("not (x.low = x.high and y.low = y.high and x.low = y.low) and "
                       "(y.settled or x.grp < y.grp or x.grp = y.grp and x.n < y.n) and not arrays_overlap(x.ahead, y.ahead)")
        return (x.join(y, (F.col("x.token") == F.col("y.token")) & apart & _possible(self.percent)
                       & _near(self.percent, "x.n", "x.sketch", "y.n", "y.sketch", ROW_BITS))
                .select("x.grp", "x.n", F.col("y.grp").alias("grp2"), F.col("y.n").alias("n2")))

    def run(self) -> DataFrame:
        """(node, component) of all nodes."""
        members, tokens = self.members(), self.tokens()
        heads = members.groupBy("grp", "n").agg(F.min(F.struct("node", "sketch")).alias("m"),
                                                F.count(F.lit(1)).alias("size"))
        heads = written(heads.select("grp", "n", "m.*", "size"), "heads")
        # star round: each token's pivot against its other groups; once, each group's head against its members
        x = tokens.select(F.col("pivot").alias("x"), F.struct("grp", "n", "pos").alias("y"))
        pair = [F.col("x.grp").alias("grp"), F.col("x.n").alias("n"), F.col("y.grp").alias("grp2"), F.col("y.n").alias("n2")]
        pairs = x.where("x.grp != y.grp or x.n != y.n").where(_possible(self.percent)).select(*pair)
        inside = heads.where("size > 1").select("grp", "n", F.col("grp").alias("grp2"), F.col("n").alias("n2"))
        head = heads.drop("size")
        links = self.stars(pairs.unionByName(inside), members, head)
        own, _ = self.merged(members.select("grp", "n", "node", F.col("node").alias("component")), links)

        def spread(own: DataFrame) -> DataFrame:
            return own.groupBy("grp", "n").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                               (F.count(F.lit(1)) == 1).alias("single"))

        # more star rounds while they halve what is left apart, or link much of it
        several = self.small(inside.select("grp", "n"))
        met = F.expr("grp = pivot.grp and n = pivot.n").alias("met")
        rows = tokens.select("token", "grp", "n", "pos", met).join(spread(own), ["grp", "n"])
        rows = self.placed(rows.where("not (single and met)"), 1)
        left = rows.count()
        for turn in range(2, STARS + 1):
            if not left:
                break
            apart = F.expr("not (y.low = y.high and x.low = x.high and x.low = y.low)")
            x = rows.select(F.explode("pivots").alias("x"), F.struct("grp", "n", "pos", "low", "high").alias("y"))
            pairs = x.where("x.grp != y.grp or x.n != y.n").where(apart & _possible(self.percent)).select(*pair)
            links = self.stars(pairs, members, head)
            own, moves = self.merged(own, links)
            shared = written(spread(own.join(several, ["grp", "n"], "left_semi")).drop("single"), "shared")
            rows = self.placed(self.followed(rows, moves, shared), turn)
            before, left = left, rows.count()
            if 2 * left > before and WORTH * links.count() < left:
                break

        # the rest: all groups of a token that are apart, and members of one group that are
        longs = ROW_BITS // 64
        folded = F.array(*[F.expr(" ^ ".join(f"sketch[{k}]" for k in range(at, SKETCH_BITS // 64, longs)))
                           for at in range(longs)])
        single = heads.where("size = 1").select("grp", "n", folded.alias("sketch"))
        rows = rows.select("token", "grp", "n", "pos", "low", "high", F.col("pivots")[0].alias("pivot"))
        cross = self.meetings(rows.join(single, ["grp", "n"], "left")).distinct()
        # of the groups that take part
        mixed = own.groupBy("grp", "n").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
            "low != high").select("grp", "n")
        cross = written(cross, "cross")
        part = cross.select("grp", "n").union(cross.select("grp2", "n2")).union(mixed).distinct()
        part = written(own.join(part, ["grp", "n"], "left_semi").join(members.select("node", "sketch"), "node"), "own")
        # in a mixed group, the members that are not with its head against all
        main = part.join(head.select("node"), "node", "left_semi").select("grp", "n", F.col("component").alias("main"))
        loose = part.join(mixed, ["grp", "n"]).join(main, ["grp", "n"]).where("component != main").drop("main")
        within = self.expanded(mixed.select("grp", "n", F.col("grp").alias("grp2"), F.col("n").alias("n2")), loose, part)
        links = self.links(self.expanded(cross, part, part).unionByName(within))
        return self.merged(own, links)[0].select("node", "component")


def _per_row(join: _Join, nodes: DataFrame, *more: str) -> DataFrame:
    """Per row of the documents: its locator, doc_id, n_shingles, component_id,
    the ``component`` and the columns ``more`` of ``nodes`` (node, doc_id,
    rows, component)."""
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    values = ["component", "component_id", *more]
    nodes = written(nodes.join(least, "component").select("node", "rows", *values), "named")
    worded = looked_up(join.sketch.where("n > 0"), nodes, "node", "rows", values)
    wordless = join.sketch.where("n = 0").select(
        "*", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id"),
        *[F.lit(0).cast("long").alias(c) for c in more])
    return worded.unionByName(wordless).select(*LOCATOR, "doc_id", F.col("n").alias("n_shingles"), *values)


def _components(docs: DataFrame, size: int, percent: int, broadcast_ids: int) -> DataFrame:
    join = _Join(docs, size, percent, broadcast_ids)
    found = join.run()
    return _per_row(join, join.nodes.join(found, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")))


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return located(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")))


def component_ids(docs: DataFrame, size: int = WORDS, percent: int = PERCENT,
                  broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id
    (the smallest doc_id reachable by links)."""
    return _components(_ids_and_texts(docs), size, percent, broadcast_ids).select("doc_id", "n_shingles", "component_id")


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT,
                    broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``component_ids`` and n_links, the number of other sets that a row's
    set is similar to.  All candidates are verified, so the work grows with
    the pairs inside a component."""
    join = _Join(_ids_and_texts(docs), size, percent, broadcast_ids)
    links = join.all_links()
    degree = (links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
              .agg(F.count(F.lit(1)).alias("n_links")))
    found = written(components(links), "components")
    return _per_row(join, join.nodes.join(found, "node", "left").join(degree, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")).withColumn(
                        "n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "n_links").select(
        "doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT,
                broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: the one with
    the smallest doc_id, or one without an id where no row of the component
    has one.  Of rows that repeat that doc_id, one of the component stays; rows
    of one doc_id in different components do not touch each other.  Rows
    without words all stay."""
    rows = located(packed(docs))
    found = _components(rows.select(F.col("row")["doc_id"].alias("doc_id"), "text", *LOCATOR), size, percent, broadcast_ids)
    found = written(found.select(*LOCATOR, "doc_id", "component"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)).alias("first")
    kept = (found.where("component is not null").groupBy("component").agg(first).select("first.at_file", "first.at_row")
            .unionByName(found.where("component is null").select(*LOCATOR)))
    return unpacked(rows.join(kept, LOCATOR, "left_semi"), docs.columns)
