"""Secret scans with corpus-wide ownership frequency.

Three fixed patterns give the base spans.  Opaque tokens of any other form
are further candidates.  The hashes of all candidates are counted over the
whole corpus by distinct owners and repositories: one that several owners have,
or that is in many repositories for each of its owners, is a widely copied
example; any other looks live.  Base spans stay and carry that class; a live
opaque token outside them adds a span.

Built-in expressions only.  Spans are found row by row, in time that grows in
proportion to a text's matches; what is shuffled is a hash, an owner and a
repository per candidate, combined on the map side, so that a token in a third
of all rows is one row per task.

Defined results: a null text is empty; a null owner or repository counts as
one more value; repeated rows are judged alike and each reported; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import looked_up, written


def _either_case(letters: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in letters)


# The base patterns and the least lengths.
ASSIGN = ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Candidates of the ownership count: opaque tokens with a digit, a capital and a small letter.
OPAQUE_LEAST = 20
OPAQUE = "[A-Za-z0-9_-]{%d,}" % OPAQUE_LEAST
#: From so many distinct owners on, a token is a copied example.
EXAMPLE_OWNERS = 3
#: Or from so many distinct repositories on for each of its owners.
EXAMPLE_REPOSITORIES = 20

KINDS = ("assign", "access", "hex", "owned")


BLOCK = 64  # of the running sums


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda total, x: total + x)


def _sums(xs: Column) -> Column:
    """The sum of each BLOCK elements."""
    blocks = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)).cast("int"), F.lit(BLOCK))
    return F.transform(blocks, lambda at: _sum(F.slice(xs, at + 1, BLOCK)))


def _with_totals(xs: Column, size, body) -> Column:
    """``body(x, the sum of the sizes before it)`` of each element: sums of
    blocks, of blocks of blocks and so on stand for what is further back, so an
    element costs a few blocks at most."""
    def part(ys: Column, i: Column) -> Column:
        start = i - i % BLOCK
        return _sum(F.slice(ys, start + 1, i % BLOCK))

    def up(i: Column, levels: int) -> Column:
        return F.floor(i / F.lit(BLOCK ** levels)).cast("int")

    def total(i: Column, s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
        return (part(s0, i) + part(s1, up(i, 1)) + part(s2, up(i, 2)) + _sum(F.slice(s3, 1, up(i, 3))))

    return _let(F.transform(xs, size), lambda s0: _let(_sums(s0), lambda s1: _let(_sums(s1), lambda s2: _let(
        _sums(s2), lambda s3: F.transform(xs, lambda x, i: body(x, total(i, s0, s1, s2, s3)))))))


def _spans(text: Column, pattern: str, may: Column, group: int, least: int) -> Column:
    """start, end, text and secret (the ``group``) of the leftmost
    non-overlapping matches whose secret has ``least`` characters, in code
    points.  The text between the matches and the matches themselves give the
    offsets."""
    matches, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    # one part more than matches: its match is null
    zipped = F.zip_with(parts, F.arrays_zip(matches.alias("m"), groups.alias("g")),
                        lambda part, m: F.struct(F.char_length(part).alias("gap"), F.char_length(m["m"]).alias("length"),
                                                 m["m"].alias("m"), m["g"].alias("g")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,secret:string>>)")
    found = _with_totals(
        zipped, lambda x: x["gap"] + F.coalesce(x["length"], F.lit(0)),
        lambda x, before: F.struct((before + x["gap"]).alias("start"), (before + x["gap"] + x["length"]).alias("end"),
                                   x["m"].alias("value"), x["g"].alias("secret")))
    return F.when(may, F.filter(found, lambda s: F.char_length(s["secret"]) >= least)).otherwise(none)


def _inside(spans: Column, s: Column) -> Column:
    """Whether one of the non-overlapping ``spans``, sorted by start, holds
    ``s``: the last that starts no later, found by halving."""
    at = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda i, step: F.when(
        F.coalesce(F.try_element_at(spans, i + step)["start"] <= s["start"], F.lit(False)), i + step).otherwise(i))
    return (at > 0) & F.coalesce(F.try_element_at(spans, F.greatest(at, F.lit(1)))["end"] >= s["end"], F.lit(False))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Row-local scan: a row number, doc_id, owner and repository, the base
    spans (``assign``, ``access``, ``hex``) and the ``opaque`` tokens."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(docs["doc_id"].alias("doc_id"), docs[owner].cast("string").alias("owner"),
                       docs[repository].cast("string").alias("repository"), text.alias("text"))
    text = F.col("text")
    # cheap tests first: few texts go through the extraction
    tests = base.withColumns({
        "may_assign": text.rlike(ASSIGN),
        "may_access": text.contains("AKIA"),
        "may_hex": text.rlike(HEX.replace("+", "{%d,}" % HEX_LEAST)),
        "may_opaque": text.rlike(OPAQUE),
    })
    return tests.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository",
        _spans(text, ASSIGN, F.col("may_assign"), 2, ASSIGN_LEAST).alias("assign"),
        _spans(text, ACCESS, F.col("may_access"), 0, ACCESS_LEAST).alias("access"),
        # runs of 32 and more are the runs of one and more that are long enough
        _spans(text, HEX.replace("+", "{%d,}" % HEX_LEAST), F.col("may_hex"), 0, HEX_LEAST).alias("hex"),
        F.filter(_spans(text, OPAQUE, F.col("may_opaque"), 0, OPAQUE_LEAST),
                 lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")
                 ).alias("opaque"))


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS,
              example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Of ``candidates`` (token, owner, repository), per token: owners,
    repositories (of each owner, added up), n and whether it is an
    ``example``."""
    pairs = candidates.groupBy("token", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = pairs.groupBy("token", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    found = per_owner.groupBy("token").agg(F.count(F.lit(1)).alias("owners"),
                                           F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    return found.withColumn("example", (F.col("owners") >= example_owners) |
                            (F.col("repositories") >= example_repositories * F.col("owners")))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS,
            example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of (start, rank,
    kind, end, value, owners, example) sorted by start and kind.  ``rank`` is
    the kind's place in KINDS; ``owners`` and ``example`` are those of the
    secret in the whole corpus."""
    scanned = written(scan(docs, owner, repository), "scan")
    kinds = [(k, name) for k, name in enumerate(("assign", "access", "hex", "opaque"))]
    # an opaque token inside a base span is no new find
    outside = F.filter("opaque", lambda s: ~(_inside(F.col("assign"), s) | _inside(F.col("access"), s)
                                             | _inside(F.col("hex"), s)))

    def marked(k: int, spans) -> Column:
        return F.transform(spans, lambda s: F.struct(
            F.lit(k).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.sha2(s["secret"], 256).alias("token")))

    spans = F.concat(*[marked(k, outside if name == "opaque" else F.col(name)) for k, name in kinds])
    found = scanned.select("row", "owner", "repository", F.explode(spans).alias("s")).select(
        "row", "owner", "repository", "s.*")
    # tokens inside base spans are counted too: it is the same secret wherever it stands
    counted = scanned.select("owner", "repository", F.explode(F.concat(*[
        F.transform(name, lambda s: F.sha2(s["secret"], 256)) for _, name in kinds])).alias("token"))
    counts = written(ownership(counted, example_owners, example_repositories), "owners")
    spans = (looked_up(found, counts, "token", "n", ["owners", "example"])
             .where((F.col("rank") < KINDS.index("owned")) | ~F.col("example")))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "rank", F.array(*map(F.lit, KINDS))[F.col("rank")].alias("kind"), "end", "value", "owners",
        "example"))).alias("spans"))
    none = spans.schema["spans"].dataType.simpleString()
    return scanned.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce("spans", F.expr(f"cast(array() as {none})")).alias("spans"))
