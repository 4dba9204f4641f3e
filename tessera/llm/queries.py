"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.tables import table

from . import (bpe, decontaminate, exact_dedup, fill_in_middle, jaccard_join, language_id, prefix_trie, quality,
               secrets, substring_dedup, topk_search, url_filter, warc)
from .common import scratch

Builder = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256",
        (F.col("n_removed") > 0).alias("repeated"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(table(spark, sf_dir, "documents"))


OP2_SQL = """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g)
  where a.doc_id != b.doc_id group by all),
links as materialized (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents
  union select reach.a, links.b from reach join links on links.a = reach.b),
c as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d left join n using (doc_id) join c on c.a = d.doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    spans = F.arrays_zip("starts", "ends")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


_OP6_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP6_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_OP6_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_OP6_WORDS} as w from benchmark),
phrases as (
  select distinct item, least(len(w), 10) as m, list_slice(w, i, i + least(len(w), 10) - 1) as p
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
sizes as (select distinct m from phrases),
windows as (
  select r, i, m, list_slice(w, i, i + m - 1) as p
  from (select r, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from d, sizes where len(w) >= m)),
hits as (select windows.r, windows.i, windows.m, phrases.item from windows join phrases using (m, p)),
hit_words as (select r, count(*) as n_hit from (
  select distinct r, unnest(generate_series(i, i + m - 1)) as k from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as joined
  from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(joined, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (r) left join items using (r)
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "owned")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size(F.filter(base, lambda s: s["example"])).cast("long").alias("n_example"))


def _op7_spans(pattern: str, group: int, least: int) -> str:
    return f"""
  select r, s, s + length(m) as e, m as v, g from (
    select r, m, g, (list_sum(list_transform(p[1:k], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(a[1:k - 1], lambda x: length(x))), 0))::bigint as s
    from (select r, p, a, k, a[k] as m, b[k] as g from (
      select r, p, a, b, unnest(generate_series(1, len(a))) as k from (
        select r, string_split_regex(t, '{pattern}') as p, regexp_extract_all(t, '{pattern}') as a,
               regexp_extract_all(t, '{pattern}', {group}) as b from d where regexp_matches(t, '{pattern}')))))
  where length(g) >= {least}"""


OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, chr(0)) as owner,
    coalesce(doc_id::varchar, chr(0)) as repository, coalesce(text, '') as t from documents),
base as (
  select 0 as o, 'assign' as kind, * from ({_op7_spans(secrets.ASSIGN.replace("'", "''"), 2, secrets.ASSIGN_LEAST)})
  union all
  select 1, 'access', * from ({_op7_spans(secrets.ACCESS, 0, secrets.ACCESS_LEAST)})
  union all
  select 2, 'hex', * from ({_op7_spans(secrets.HEX.replace("+", "{%d,}" % secrets.HEX_LEAST), 0, secrets.HEX_LEAST)})),
opaque as (
  select * from ({_op7_spans(secrets.OPAQUE, 0, secrets.OPAQUE_LEAST)})
  where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')),
judged as (select g, count(distinct owner) >= {secrets.EXAMPLE_OWNERS} or count(distinct (owner, repository))
    >= {secrets.EXAMPLE_REPOSITORIES} * count(distinct owner) as example
  from (select r, g from base union all select r, g from opaque) join d using (r) group by g),
added as (
  select 3 as o, 'owned' as kind, x.* from opaque x
  where not exists (select 1 from base b where b.r = x.r and b.s <= x.s and x.e <= b.e)),
spans as (select * from (select * from base union all select * from added) join judged using (g)
  where o < 3 or not example),
joined as (
  select r, count(*) filter (o = 0) as n_assign, count(*) filter (o = 1) as n_access, count(*) filter (o = 2) as n_hex,
         string_agg(concat(kind, ':', s, ':', e), ',' order by s, o) filter (o < 3) as base,
         string_agg(concat(kind, ':', s, ':', e), ',' order by s, o) as spans,
         count(*) filter (o < 3 and example) as n_example
  from spans group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_example, 0)::bigint as n_example
from d left join joined using (r)
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe.word_bpe_file())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op4_sql() -> str:
    """Both ranks by recursion, a row per host and round, until they settle."""
    rules = " union all ".join(f"select '{h}' as h, '{p}' as p, '{v}' as v" for (h, p), v in url_filter.RULES)
    link, d = url_filter.LINK.replace("'", "''"), url_filter.DAMPING
    ranks = []
    for kind, links in (("allow", "edges"), ("block", "against")):
        ranks.append(f"""
{kind}_seed as materialized (select host, 1.0::double / count(*) over () as share from hosts
  where {kind}ed >= {url_filter.SEED_SHARE} * n),
{kind}_rounds as (
  select 0 as k, host, share as rank, false as settled from {kind}_seed
  union all
  select k, host, rank, k % {url_filter.CUT_EVERY} = 0 and bool_and(near) over () as settled from (
    select n.k, n.host, n.rank, coalesce(abs(n.rank - o.rank) <= {url_filter.TOLERANCE} * n.rank, false) as near
    from (select k + 1 as k, host, sum(rank) as rank from (
        select k, dst as host, {d} * rank * weight as rank from {kind}_rounds join {links} on src = host where not settled
        union all
        select k, s.host, (1 - {d}) * share as rank from {kind}_seed s
          join (select distinct k from {kind}_rounds where not settled) r on true) m group by k, host) n
      left join {kind}_rounds o on o.host = n.host) c
  where k <= {url_filter.MOST_ROUNDS}),
{kind}_rank as (select host, rank from {kind}_rounds where settled)""")
    return f"""
with recursive u as materialized (select page_id, html,
    lower(regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 1)) as host,
    regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 2) as path from pages),
rules as ({rules}),
r as materialized (select u.*, (select max_by(struct_pack(rule := h || p, v := v), length(h || p)) from rules
    where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as m from u),
hosts as materialized (select host, count(*) as n, count(*) filter (m.v = 'allow') as allowed,
    count(*) filter (m.v = 'block') as blocked from r where host != '' group by host),
links as materialized (select src, dst, count(*) as n from (
    select host as src, lower(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1))) as dst from u)
  where src != '' and src != dst group by src, dst),
edges as materialized (select src, dst, n / sum(n) over (partition by src) as weight from links),
against as materialized (select dst as src, src as dst, weight / sum(weight) over (partition by dst) as weight from edges),
{",".join(ranks)}
select page_id, r.host, path, m.rule as rule, coalesce(m.v, case when coalesce(b.rank, 0) > 0
    and b.rank >= {url_filter.THRESHOLD} * (coalesce(a.rank, 0) + b.rank) then 'block' else 'allow' end) as verdict
from r left join allow_rank a on a.host = r.host left join block_rank b on b.host = r.host
"""


OP4_SQL = _op4_sql()


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit_outside_fold(docs)).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    warc.write(warc.records(pages), path)
    found = warc.resolved(warc.read(spark, path))
    page_id = pages.schema["page_id"].dataType
    return found.select(F.col("id").cast(page_id).alias("page_id"), F.col("bytes").alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
                        F.col("refers_to").cast(page_id).alias("refers_to"))


OP9_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, octet_length(encode(html)) as payload_bytes,
             min(page_id) over (partition by html) as first,
             unhex(sha1(html))::bit::varchar as bits from p)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(generate_series(0, 4), lambda j:
           (substr(bits, (5 * k + j + 1)::bigint, 1) = '1')::int * (16 >> j::int)))::int, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from d
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.where(~out), labels.where(~out))
    return quality.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP11_SQL = """
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
d as (select doc_id, t, length(t)::bigint as n,
    ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2,
    ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
o as (select doc_id, n, form, t, case when form != 'plain' then a end as prefix_chars,
    case when form != 'plain' then b - a end as middle_chars,
    case form when 'plain' then t
      when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
      else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end as output
  from c),
p as (select *, string_split_regex(substr(output, 4), '<[PSM]>') as parts from o)
select doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256,
  sha256(case form when 'plain' then output when 'psm' then parts[1] || parts[3] || parts[2]
    else parts[2] || parts[3] || parts[1] end) as restored_sha256
from p
"""


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
with v as materialized (select row_number() over () as r, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id as vec_id,
    coalesce(list_sum(list_transform(generate_series(1, least(len(q.e), len(c.e))),
      lambda i: q.e[i] * c.e[i])), 0)::bigint as score
  from v q join v c on q.r != c.r where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = """
with t as (select conv_id, list(struct_pack(k := k, b := b) order by turn nulls first, k) as w from (
    select conv_id, turn, strlen(coalesce(text, '')) as b,
      sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k
    from conversations where conv_id is not null) group by conv_id),
h as (select conv_id, w, conv_id - conv_id % 5 as base, xor(list_reduce(list_concat([4294967295::bigint],
    flatten(list_transform(string_split(conv_id::varchar, ''),
      lambda c: [1000 + ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: case when x >= 1000 then xor(c, x - 1000) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end),
  4294967295) % 9 as h from t),
r as (select h.conv_id, list_concat(coalesce(list_slice(x.w, 1, h.h), []),
    list_slice(h.w, h.h + 1, len(h.w))) as w from h left join t x on x.conv_id = h.base),
p as (select conv_id, list_transform(w, lambda x: x.k) as k, list_transform(w, lambda x: x.b) as b,
    unnest(generate_series(0, len(w))) as depth from r),
q as materialized (select conv_id, depth, len(k) = depth as ended, coalesce(b[depth], 0) as b,
    sha256(array_to_string(list_slice(k, 1, depth), ',')) as id,
    sha256(array_to_string(list_slice(k, 1, depth - 1), ',')) as up from p),
n as (select depth, id, any_value(up) as up, any_value(b) as b, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends_sha256
  from q group by depth, id),
f as materialized (select n.*, coalesce(c.n, 0) as n_children from n
  left join (select up, count(*) as n from n where depth > 0 group by up) c on c.up = n.id),
s as (select a.id, sum((f.n_children = 0)::int) as n_leaves, sum((f.n_convs - 1) * f.b) as saved_tokens
  from f join q a on a.conv_id = f.conv_id and a.depth <= f.depth group by a.id)
select f.conv_id, f.depth::bigint as depth, u.conv_id as parent_conv_id, f.n_convs::bigint as n_convs,
  f.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens,
  f.ends_sha256
from f join s on s.id = f.id left join f u on f.depth > 0 and u.id = f.up
"""


def queries() -> dict[str, Builder]:
    import corpus_pipeline
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    by_number = {k.split("_")[0]: k for k in queries()}
    found = {by_number[k.removesuffix("_SQL").lower()]: v for k, v in globals().items() if k.endswith("_SQL")}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
