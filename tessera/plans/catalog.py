"""Weight-catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as CA
from tessera.operators.joins import reconcile
from tessera.plans import fixtures as FX
from tessera.plans.assembly import sql_values
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.registry import query

def size_col():
    return F.col("dim0").cast("bigint") * F.col("dim1").cast("bigint")


def component_col():
    return F.get(F.split(F.col("name"), r"\."), 1)


def is_router():
    return F.col("name").contains(".gate.")
VIS = "select regexp_replace(name, '^model\\.', '') as clean_name, dim0, dim1, dim0 * dim1 as size, trainable from tensor_catalog where starts_with(name, 'model.visual.')"


def vision(spark, sf):
    return CA.under_prefix(FX.tensor_catalog(spark, sf), "name", "model.visual.", "model.")


def _cat(body: str, vis: bool = False) -> str:
    return with_fixtures(body, "tensor_catalog", extra={"vis": VIS} if vis else None)


@query("vision_tensors", _cat("select clean_name, dim0, dim1 from vis", vis=True))
def vision_tensors(spark, sf):
    """the vision tower's tensors, ``model.`` stripped."""
    return vision(spark, sf).select("clean_name", "dim0", "dim1")


@query("size_rollup", _cat("""
select coalesce(component, 'ALL') as component, count(*) as n_tensors, cast(sum(n) as bigint) as params,
       cast(sum(n * elem_bytes) as bigint) as bytes
from (select split_part(name, '.', 2) as component, dim0 * dim1 as n, elem_bytes from tensor_catalog) t
group by rollup(component)"""))
def size_rollup(spark, sf):
    """A3: parameters and bytes per component and in total."""
    c = FX.tensor_catalog(spark, sf)
    return CA.size_rollup(c, component_col(), F.array("dim0", "dim1"))


@query("hierarchy_exact", _cat("""
select array_to_string(list_slice(string_split(clean_name, '.'), 1, 3), '.') as prefix,
       count(*) as n_tensors, cast(sum(size) as bigint) as params
from vis group by 1""", vis=True))
def hierarchy_exact(spark, sf):
    """A4 exact: group by the first three segments."""
    return CA.hierarchy_rollup(vision(spark, sf), "clean_name", size_col(), 3, "exact")


@query("hierarchy_prefix", _cat("""
select p.prefix, count(*) as n_tensors, cast(sum(v.size) as bigint) as params
from (select distinct array_to_string(list_slice(string_split(clean_name, '.'), 1, 3), '.') as prefix from vis) p
join vis v on starts_with(v.clean_name, p.prefix) group by p.prefix""", vis=True))
def hierarchy_prefix(spark, sf):
    """A4 prefix (J8 + J4): ``startswith`` matching as in the source, so a
    block's prefix also counts the blocks whose number extends it."""
    return CA.hierarchy_rollup(vision(spark, sf), "clean_name", size_col(), 3, "prefix")


@query("trainable_stats", _cat("""
select total_params, trainable_params,
       round(trainable_params::double * 100.0 / total_params::double, 6) as trainable_pct
from (select cast(sum(dim0 * dim1) as bigint) as total_params,
             cast(coalesce(sum(dim0 * dim1) filter (where trainable), 0) as bigint) as trainable_params
      from tensor_catalog) t"""))
def trainable_stats(spark, sf):
    """A5: trainable share of the parameters."""
    return CA.trainable_stats(FX.tensor_catalog(spark, sf), size_col())


@query("router_warnings", _cat("""
select name, 'Router weight ' || name || ' is trainable! Should be frozen.' as warning
from tensor_catalog where contains(name, '.gate.') and trainable"""))
def router_warnings(spark, sf):
    """A5 warning rows."""
    return CA.router_warnings(FX.tensor_catalog(spark, sf), "name", is_router())


@query("routers_frozen", _cat("""
select split_part(name, '.', 2) as component,
       coalesce(bool_and(not trainable) filter (where contains(name, '.gate.')), true) as routers_frozen
from tensor_catalog group by 1"""))
def routers_frozen(spark, sf):
    """A6 per component."""
    return CA.all_frozen(FX.tensor_catalog(spark, sf), is_router(), component_col())


REQUIRED = ["patch_embed", "merger", "blocks.0", "blocks.26"]


@query("required_components", _cat(" union all ".join(
    f"select '{p}' as pattern, coalesce(bool_or(contains(clean_name, '{p}')), false) as present from vis"
    for p in REQUIRED), vis=True))
def required_components(spark, sf):
    """F8: patch embedding, merger, first and last block present."""
    return CA.check_required(vision(spark, sf), "clean_name", REQUIRED)


RULES = [("vision_params", ">", 500000000.0), ("n_tensors", ">=", 1000.0),
         ("hidden", "==", 4096.0), ("trainable_params", ">", 30000000.0)]


@query("expectation_checks", _cat(f"""
select r.metric, m.value, r.op, r.threshold,
  coalesce(case r.op when '>' then m.value > r.threshold when '>=' then m.value >= r.threshold
    when '<' then m.value < r.threshold when '<=' then m.value <= r.threshold
    when '==' then m.value = r.threshold end, false) as passed
from rules r left join (
  select 'vision_params' as metric, cast(sum(dim0 * dim1) filter (where starts_with(name, 'model.visual.')) as double) as value from tensor_catalog
  union all select 'n_tensors', cast(count(*) as double) from tensor_catalog
  union all select 'hidden', cast(max(dim0) as double) from tensor_catalog
  union all select 'trainable_params', cast(sum(dim0 * dim1) filter (where trainable) as double) from tensor_catalog
) m on r.metric = m.metric""".replace("from rules r", f"from ({sql_values(RULES, ['metric', 'op', 'threshold'])}) r")))
def expectation_checks(spark, sf):
    """metrics of the catalog against threshold rules."""
    c = FX.tensor_catalog(spark, sf)
    vis = F.col("name").startswith("model.visual.")
    a = c.agg(F.sum(F.when(vis, size_col())).cast("double").alias("vision_params"),
              F.count(F.lit(1)).cast("double").alias("n_tensors"),
              F.max("dim0").cast("double").alias("hidden"),
              F.sum(F.when(F.col("trainable"), size_col())).cast("double").alias("trainable_params"))
    metrics = a.selectExpr("stack(4, 'vision_params', vision_params, 'n_tensors', n_tensors, "
                           "'hidden', hidden, 'trainable_params', trainable_params) as (metric, value)")
    rules = F.broadcast(spark.createDataFrame(RULES, "metric string, op string, threshold double"))
    return CA.check_expectations(metrics, rules)


@query("reconcile_keys", _cat("""
select coalesce(e.k, a.k) as name,
  case when a.k is null then 'missing' when e.k is null then 'unexpected' else 'ok' end as status
from (select distinct replace(clean_name, 'visual.', '') as k from vis where dim0 % 5 <> 0) e
full outer join (select distinct replace(clean_name, 'visual.', '') as k from vis where dim1 % 7 <> 0) a on e.k = a.k""",
    vis=True).replace("replace(clean_name, 'visual.', '')", "regexp_replace(clean_name, 'visual\\.', '')"))
def reconcile_keys(spark, sf):
    """Model keys against checkpoint keys (``visual.`` removed once)."""
    v = vision(spark, sf).withColumn("name", F.regexp_replace("clean_name", r"visual\.", ""))
    expected = v.where(F.col("dim0") % 5 != 0)
    actual = v.where(F.col("dim1") % 7 != 0)
    return reconcile(expected, actual, "name")


@query("latest_by_name", _cat("""
select split_part(name, '.', 2) as component, max(name) as latest_name, count(*) as n_names
from tensor_catalog group by 1"""))
def latest_by_name(spark, sf):
    """Lexically latest name per component."""
    return CA.latest_by_name(FX.tensor_catalog(spark, sf), component_col(), "name")


@query("listed_names", _cat("""
select component, name, row_number() over (partition by component order by name) as place
from (select distinct split_part(name, '.', 2) as component, name from tensor_catalog) q"""))
def listed_names(spark, sf):
    """The sorted listing of each component's names."""
    return CA.listed_names(FX.tensor_catalog(spark, sf), "name", component_col())
