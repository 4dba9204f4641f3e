"""Image geometry, schedules and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import geometry as GE
from tessera.functions.prompts import preview
from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.registry import query
from tessera.sources.corpus import scan_corpus


def _resize_sql(w: str, h: str, target: int) -> tuple[str, str]:
    f = lambda side: (f"greatest(32, cast(round_even({side}::double * ({target}::double / greatest({w}, {h})::double)"  # noqa: E731
                      f" / 32.0, 0) * 32 as bigint))")
    return f(w), f(h)


RW, RH = _resize_sql("w", "h", 672)


@query("resize_plan", with_fixtures(f"""
select image_id, new_w, new_h, 1 as grid_t, new_h // 16 as grid_h, new_w // 16 as grid_w,
       (new_h // 16 // 2) * (new_w // 16 // 2) as n_tokens
from (select image_id, {RW} as new_w, {RH} as new_h from img_dims) r""", "img_dims"))
def resize_plan(spark, sf):
    """G1 resize plan -> G2 patch grid -> G3 image token count."""
    d = FX.img_dims(spark, sf)
    nw, nh = GE.resize_plan("w", "h")
    r = d.select("image_id", nw.alias("new_w"), nh.alias("new_h"))
    t, gh, gw = GE.patch_grid("new_w", "new_h")
    return r.select("image_id", "new_w", "new_h", t.alias("grid_t"), gh.alias("grid_h"), gw.alias("grid_w"),
                    GE.num_image_tokens("new_w", "new_h").alias("n_tokens"))


CACHE_SIZES = [448, 672]


def _cache_size_sql():
    parts = []
    for s in CACHE_SIZES:
        w, h = _resize_sql("w", "h", s)
        parts.append(f"""select {s} as target_size, count(*) as n_images,
  cast(sum(((({h}) // 16 // 2) * (({w}) // 16 // 2))) as bigint) as total_tokens,
  cast(sum(((({h}) // 16 // 2) * (({w}) // 16 // 2))) * {K.VISION_DIM} * {K.FP16_BYTES} as bigint) as total_bytes
from img_dims""")
    return with_fixtures(" union all ".join(parts), "img_dims")


@query("cache_size_plan", _cache_size_sql())
def cache_size_plan(spark, sf):
    """Feature-cache bytes per target size.  One scan computes every
    size's token count as a column and one global aggregate sums them
    (partial sums per task, one final row); ``stack`` turns the columns
    into rows.  No cross join with the size list."""
    d = FX.img_dims(spark, sf)
    aggs = []
    for s in CACHE_SIZES:
        nw, nh = GE.resize_plan("w", "h", s)
        aggs.append(F.sum(GE.num_image_tokens(nw, nh)).alias(f"t{s}"))
    a = d.agg(F.count(F.lit(1)).alias("n_images"), *aggs)
    stack = "stack({n}, {args}) as (target_size, total_tokens)".format(
        n=len(CACHE_SIZES), args=", ".join(f"{s}, t{s}" for s in CACHE_SIZES))
    out = a.selectExpr("n_images", stack)
    return out.select(F.col("target_size").cast("int").alias("target_size"), "n_images",
                      F.col("total_tokens").cast("bigint").alias("total_tokens"),
                      (F.col("total_tokens") * K.VISION_DIM * K.FP16_BYTES).cast("bigint").alias("total_bytes"))


LR, WARMUP, TOTAL = 1e-3, 200, 10000


@query("lr_schedule", with_fixtures(f"""
select stage, step, round({LR} * case when step < {WARMUP} then step::double / {WARMUP}
   else greatest(0.0, 0.5 * (1.0 + cos(pi() * (step - {WARMUP})::double / {TOTAL - WARMUP}))) end, 12) as lr
from step_log""", "step_log"))
def lr_schedule(spark, sf):
    """G5 on the logged steps: warm-up then half cosine, unclamped past the
    planned end (the factor rises again)."""
    s = FX.step_log_rows(spark, sf)
    return s.select("stage", "step", F.round(F.lit(LR) * GE.lr_factor("step", WARMUP, TOTAL), 12).alias("lr"))


@query("planned_steps", """
select n_samples, 32 as grad_accum, least(n_samples // 32, 1000) as planned_steps
from (select count(*) as n_samples from (select conv_id from conversations group by conv_id
      having count(*) filter (where role = 'assistant' and text <> '') > 0) c) q""")
def planned_steps(spark, sf, accum: int = 32, max_steps: int = 1000):
    """Corpus size // accumulation, capped by max_steps."""
    c = scan_corpus(spark, f"{sf}/conversations.parquet")
    n = c.groupBy("conv_id").agg(F.count(F.when((F.col("role") == "assistant") & (F.col("text") != ""),
                                                 F.lit(1))).alias("k")).where(F.col("k") > 0)
    a = n.agg(F.count(F.lit(1)).alias("n_samples"))
    return a.select("n_samples", F.lit(accum).alias("grad_accum"),
                    F.least(F.floor(F.col("n_samples") / accum), F.lit(max_steps)).cast("bigint").alias("planned_steps"))


@query("response_preview", with_fixtures("""
select doc_id, run, substring(response, 1, 200) as preview, tokens,
       round_even(case when elapsed_s > 0 then tokens / elapsed_s else 0.0 end, 1) as tps
from evals""", "evals"))
def response_preview(spark, sf):
    """P14 preview and G7 tokens/s (guarded at 0 s), one decimal."""
    e = FX.evals(spark, sf)
    return e.select("doc_id", "run", preview("response").alias("preview"), "tokens",
                    F.bround(GE.rate("tokens", "elapsed_s"), 1).alias("tps"))
