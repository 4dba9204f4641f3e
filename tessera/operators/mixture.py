"""Source caps and mixing (M1-M3, A1).

Sampling decisions are hashes of ``seed:id``, never ``rand()``: a re-run,
a retried task or a lost executor reproduces the same mixture regardless of
partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sampling import bernoulli, hash_u32
from tessera.operators.ranking import global_rank
from tessera.operators.selection import first_candidates


def text_probability(ratio: float) -> float:
    """Per-VL-row probability of a following text row so that the expected
    text share of the stream is ``ratio``; only ratio <= 0.5 is reachable."""
    if not 0.0 <= ratio <= 0.5:
        raise ValueError("text ratio must be within [0, 0.5]")
    return ratio / (1.0 - ratio) if ratio < 0.5 else 1.0


def mix_text(vl: DataFrame, id_col: str, ratio: float, seed: int, order_cols=None,
             rows_per_bucket: int | None = None) -> DataFrame:
    """M1: after each VL row, a text row follows with p = r/(1-r).  Returns
    the VL rows and the text slots, ordered by ``(vl_rank, is_text)``;
    the text content is attached by ``pick_from_pool``."""
    p = text_probability(ratio)
    ranked = global_rank(vl, order_cols or [id_col], [], rows_per_bucket=rows_per_bucket, rank_col="vl_rank")
    vl_rows = ranked.withColumn("is_text", F.lit(False))
    text_rows = ranked.where(bernoulli(seed, F.col(id_col), p)).withColumn("is_text", F.lit(True))
    return vl_rows.unionByName(text_rows)


def pick_from_pool(df: DataFrame, key_col: str, pool: DataFrame, seed: int, pool_size: int,
                   idx_col: str = "pool_idx") -> DataFrame:
    """M2: a uniform choice out of a pool of ``pool_size`` rows (with a
    0-based ``pool_idx``) by ``hash mod n``.  How the pool is joined is left
    to its size."""
    keyed = df.withColumn(idx_col, F.pmod(hash_u32(f"pool{seed}", F.col(key_col)), F.lit(pool_size)))
    return keyed.join(pool, idx_col, "left")


def pool_frame(spark: SparkSession, rows: Sequence[tuple[str, str]], idx_col: str = "pool_idx") -> DataFrame:
    return spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)],
                                 f"{idx_col} bigint, question string, answer string")


def mix_weighted(sources: Mapping[str, tuple[DataFrame, float]], total: int, id_col: str, seed: int,
                 source_col: str = "source") -> DataFrame:
    """M3: exact quotas ``floor(total * w)`` per source, each filled by the
    rows of smallest ``hash(seed:id)``; a short source contributes all it
    has.  The sources are one table, from which a cutoff on the hash selects
    about twice each quota before anything is ranked, so that neither a huge
    source nor many of them are sorted."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn(source_col, F.lit(name)) for name, (df, _) in sources.items()])
    quota = F.create_map(*[x for name, (_, w) in sources.items() for x in (F.lit(name), F.lit(int(total * w)))])
    quota = quota[F.col(source_col)]
    hashed = rows.withColumn("_h", hash_u32(seed, F.col(id_col)))
    ranked = global_rank(first_candidates(hashed, [source_col], quota, "_h"), ["_h", id_col], [source_col], rank_col="_qr")
    return ranked.where(F.col("_qr") <= quota).drop("_h", "_qr")


def yield_counts(df: DataFrame, config_col: str = "config") -> DataFrame:
    """A1: rows yielded per config (partial counts per task, then merge)."""
    return df.groupBy(config_col).agg(F.count(F.lit(1)).alias("n_rows"))
