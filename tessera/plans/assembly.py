"""Corpus assembly: caps, mixing, multi-config scans, assets
(W1, W2, M1-M3, S2, S8, J3, J7, A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators import mixture as MX
from tessera.operators import ranking as RK
from tessera.operators.joins import resolve_against
from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.registry import query
from tessera.plans.samples import chat_samples_df, sql_strip
from tessera.sources.corpus import resolve_assets, scan_configs, scan_corpus

SEED = 17

# conv_ids that yield a chat sample (non-empty stripped last assistant turn)
VL_IDS_SQL = ("select conv_id from conversations group by conv_id having coalesce("
              + sql_strip("arg_max(text, turn) filter (where role='assistant')") + ", '') <> ''")


def sql_hash(seed, key: str) -> str:
    return f"cast(('0x' || substr(md5('{seed}' || ':' || cast({key} as varchar)), 1, 8)) as bigint)"


def sql_values(rows, cols) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) t({', '.join(cols)})"


@query("cap_per_config", """
select source, doc_id from (
  select source, doc_id, row_number() over (partition by source order by doc_id) as rn
  from documents where n_chars >= 100) q where rn <= 30""")
def cap_per_config(spark, sf):
    """First 30 valid rows per source (the filter runs first: caps count
    yields).  Two-phase rank: a source holding a third of the corpus is
    ranked in range slices, not in one task."""
    d = scan_corpus(spark, f"{sf}/documents.parquet").where(F.col("n_chars") >= 100).select("source", "doc_id")
    return RK.cap_per_key(d, "source", 30, ["doc_id"])


@query("cap_total", f"select conv_id from ({VL_IDS_SQL}) c order by conv_id limit 50")
def cap_total(spark, sf):
    """Global cap of 50 emitted samples (top-n per task, one merge)."""
    return RK.cap_total(chat_samples_df(spark, sf).select("conv_id"), 50, ["conv_id"])


P_TEXT = MX.text_probability(0.2)
POOL_SQL = sql_values([(i, q, a) for i, (q, a) in enumerate(K.TEXT_PROMPT_POOL)],
                      ["pool_idx", "question", "answer"])


@query("mix_text", with_fixtures(f"""
select conv_id, vl_rank, false as is_text, cast(null as bigint) as pool_idx, cast(null as varchar) as question from r
union all
select r.conv_id, r.vl_rank, true as is_text, p.pool_idx, p.question
from r join pool p on p.pool_idx = {sql_hash('pool' + str(SEED), 'r.conv_id')} % 5
where {sql_hash(SEED, 'r.conv_id')} < {P_TEXT} * 4294967296.0""", extra={
    "r": f"select conv_id, row_number() over (order by conv_id) as vl_rank from ({VL_IDS_SQL}) s",
    "pool": POOL_SQL}))
def mix_text(spark, sf):
    """M1 + M2: chat samples in conv_id order; after each, with probability
    r/(1-r) for r = 0.2, a text-only slot filled from the fixed pool."""
    vl = chat_samples_df(spark, sf).select("conv_id")
    m = MX.mix_text(vl, "conv_id", 0.2, SEED)
    pool = MX.pool_frame(spark, K.TEXT_PROMPT_POOL)
    text = MX.pick_from_pool(m.where("is_text"), "conv_id", pool, SEED, len(K.TEXT_PROMPT_POOL))
    vl_rows = m.where(~F.col("is_text")).select("conv_id", "vl_rank", "is_text",
                                                F.lit(None).cast("bigint").alias("pool_idx"),
                                                F.lit(None).cast("string").alias("question"))
    return vl_rows.unionByName(text.select("conv_id", "vl_rank", "is_text", "pool_idx", "question"))


@query("pick_from_pool", with_fixtures(f"""
select c.conv_id, p.question, p.answer from (select distinct conv_id from conversations) c
join pool p on p.pool_idx = {sql_hash('pool' + str(SEED), 'c.conv_id')} % 5""", extra={"pool": POOL_SQL}))
def pick_from_pool(spark, sf):
    """M2 alone: one pool prompt per conversation."""
    c = scan_corpus(spark, f"{sf}/conversations.parquet").select("conv_id").distinct()
    pool = MX.pool_frame(spark, K.TEXT_PROMPT_POOL)
    return MX.pick_from_pool(c, "conv_id", pool, SEED, len(K.TEXT_PROMPT_POOL)) \
        .select("conv_id", "question", "answer")


MIX_WEIGHTS = {"en": 0.4, "fr": 0.4, "de": 0.2}
MIX_TOTAL = 300


@query("mix_weighted", " union all ".join(
    f"""select '{lang}' as source, doc_id from (select doc_id, row_number() over (order by {sql_hash(SEED, 'doc_id')}, doc_id) as rn
    from documents where lang = '{lang}') q{i} where rn <= {int(MIX_TOTAL * w)}"""
    for i, (lang, w) in enumerate(MIX_WEIGHTS.items())))
def mix_weighted(spark, sf):
    """M3: 40/40/20 over three languages with exact quotas of 300 rows."""
    d = scan_corpus(spark, f"{sf}/documents.parquet").select("doc_id", "lang")
    srcs = {lang: (d.where(F.col("lang") == lang).select("doc_id"), w) for lang, w in MIX_WEIGHTS.items()}
    return MX.mix_weighted(srcs, MIX_TOTAL, "doc_id", SEED).select("source", "doc_id")


CONFIGS = ["en", "fr", "de", "es"]


@query("config_yield", """
select config, ordinal, ok, n_rows from (
  select lang as config, case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end as ordinal,
         true as ok, count(*) as n_rows
  from documents where lang in ('en', 'fr', 'de', 'es') group by lang
  union all select 'missing' as config, 4 as ordinal, false as ok, 0 as n_rows) q""")
def config_yield(spark, sf):
    """S2 + J7 + A1: configs read in list order (one unreadable), tagged,
    unioned by name, and all their rows counted.  The failed config is
    reported with zero rows.  (The cap per config is W1, cap_per_config.)"""
    path = f"{sf}/documents.parquet"
    configs = {c: (lambda c=c: scan_corpus(spark, path).where(F.col("lang") == c)) for c in CONFIGS}
    configs["missing"] = f"{sf}/missing_config.parquet"
    union, status = scan_configs(spark, configs)
    y = MX.yield_counts(union.select("config"))
    return status.join(y, "config", "left").select(
        "config", F.col("ordinal").cast("bigint").alias("ordinal"), "ok",
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


BASE_URL = "https://assets.example.invalid/images/"


@query("resolve_assets", with_fixtures(f"""
select v.sample_id, v.turn, '{BASE_URL}' || v.image_ref as asset_url, p.page_id
from vl_conv v join pages p on v.image_ref = 'img_' || cast(p.page_id as varchar) || '.png'
where v.image_ref is not null""", "vl_conv"))
def resolve_assets_q(spark, sf):
    """S8 + J3: image names become URLs, then are joined to the asset table
    (here the pages, one asset per page); unresolved rows drop out."""
    v = resolve_assets(FX.vl_conv(spark, sf), "image_ref", BASE_URL)
    assets = scan_corpus(spark, f"{sf}/pages.parquet").select(
        "page_id", F.concat(F.lit("img_"), F.col("page_id").cast("string"), F.lit(".png")).alias("asset_name"))
    j = resolve_against(v, assets, "image_ref", "asset_name")
    return j.select("sample_id", "turn", "asset_url", "page_id")


@query("unresolved_assets", with_fixtures("""
select v.sample_id, v.turn, v.image_ref from vl_conv v
where v.image_ref is not null and not exists (
  select 1 from pages p where v.image_ref = 'img_' || cast(p.page_id as varchar) || '.png')""", "vl_conv"))
def unresolved_assets(spark, sf):
    """J3 reject list by anti-join."""
    v = resolve_assets(FX.vl_conv(spark, sf), "image_ref", BASE_URL)
    assets = scan_corpus(spark, f"{sf}/pages.parquet").select(
        F.concat(F.lit("img_"), F.col("page_id").cast("string"), F.lit(".png")).alias("asset_name"))
    return resolve_against(v, assets, "image_ref", "asset_name", "left_anti").select("sample_id", "turn", "image_ref")
