"""URL filter: rules first, then trust and distrust over the host link graph.

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's; the longest fitting rule decides.  What no rule fits
is judged by its host.  Trust is the personalised PageRank from trusted seeds
along the links between hosts; distrust is the one from blocked seeds against
the links, as who links to a blocked host shares its blame.  A host is blocked
when distrust is at least ``threshold`` of both together.

Seeds are the hosts of which the rules allow, or block, at least
``seed_share`` of the pages.  Links are the absolute and protocol-relative
targets of href and src; a relative target stays on its host and is no edge.

Host tables only are joined and aggregated, combined on the map side; ranks
are written to the shared folder every few rounds to cut lineage.  Rounds go on
until no host is newly reached and no rank changes by more than ``tolerance``
of itself, so a host of any distance from the seeds has its rank; ranks that do
not settle within ``most_rounds`` are an error.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; null html has no links; repeated rows are
judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, written

# The rules as (host, path) and their verdicts.
RULES = [(("net", "/"), "block"), (("example.net", "/en/"), "allow"),
         (("example.com", "/de/"), "block"), (("org", "/fr/"), "allow")]
MOST_RULES = 1000
#: The rounds that OP4_SQL writes out; the operator goes on until ranks settle.
TOLERANCE = 1e-9
MOST_ROUNDS = 10_000
DAMPING = 0.85
SEED_SHARE = 0.5
THRESHOLD = 0.5
CUT_EVERY = 5

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len("".join(r[0])), r[0]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (h, p), v in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight: the share of the source's links to other hosts."""
    host, _ = host_and_path(F.col("url"))
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    links = (pages.select(host.alias("src"), F.explode(targets).alias("dst"))
             .withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src != '' and src != dst")
             .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    total = links.groupBy("src").agg(F.sum("n").alias("total"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS,
               damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank over ``edges`` (src, dst, weight)
    from ``seeds`` (host, share; shares add up to one)."""
    start = seeds.select("host", (F.col("share") * (1 - damping)).alias("rank"))
    if edges.isEmpty():
        return start
    rank, none = seeds.select("host", F.col("share").alias("rank")), F.lit(None).cast("double")
    for k in range(1, most_rounds + 1):
        moved = (rank.join(edges, rank["host"] == edges["src"])
                 .groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("weight")) * damping).alias("rank")))
        rows = moved.unionByName(start)
        if k % CUT_EVERY and k < most_rounds:
            rank = rows.groupBy("host").agg(F.sum("rank").alias("rank"))
            continue
        # with the rank of the round before, which a host that is new has not
        rows = rows.withColumn("before", none).unionByName(
            rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("before")))
        rank = written(rows.groupBy("host").agg(F.sum("rank").alias("rank"), F.max("before").alias("before")), "rank")
        moving = F.col("before").isNull() | (F.abs(F.col("rank") - F.col("before")) > tolerance * F.col("rank"))
        settled, rank = rank.where(moving).isEmpty(), rank.select("host", "rank")
        if settled:
            return rank
    raise RuntimeError(f"ranks did not settle in {most_rounds} rounds")


def judged(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, damping: float = DAMPING,
           seed_share: float = SEED_SHARE, threshold: float = THRESHOLD, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule,
    verdict, and the host's trust and distrust."""
    pages = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = written(urls.where("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"),
        F.count_if(F.col("ruled") == "block").alias("blocked")), "hosts")
    edges = written(host_edges(pages), "edges")
    total = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    against = edges.join(total, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                              (F.col("weight") / F.col("into")).alias("weight"))

    def rank(kind: str, links: DataFrame, name: str) -> DataFrame:
        seeds = hosts.where(F.col(kind) >= seed_share * F.col("n")).select("host")
        n = seeds.count()
        return propagated(links, seeds.withColumn("share", F.lit(1.0 / max(n, 1))), tolerance, most_rounds, damping) \
            .withColumnRenamed("rank", name)

    scores = rank("allowed", edges, "trust").join(rank("blocked", against, "distrust"), "host", "full")
    found = urls.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return found.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
