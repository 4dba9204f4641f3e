"""Reproducible hash sampling (M1-M3).

``rand(seed)`` depends on partitioning and task retries; a hash of
``seed:id`` does not, so a re-run or a lost executor yields the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col_

TWO_32 = float(2 ** 32)


def hash_u32(seed, key) -> Column:
    """First 32 bits of ``md5(seed:key)`` as a non-negative integer."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), col_(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def bernoulli(seed, key, p: float) -> Column:
    """True with probability ``p``, decided by the hash alone."""
    return hash_u32(seed, key) < F.lit(p * TWO_32)
