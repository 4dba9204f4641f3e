"""Image geometry, schedules and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import col_


def resize_side(side, longest, target: int = K.TARGET_SIZE,
                patch: int = K.PATCH_SIZE, merge: int = K.SPATIAL_MERGE) -> Column:
    """One side of the resize plan (G1): scale the longest side to ``target``,
    round half-even to a multiple of patch*merge, at least one unit.  The
    operation order (scale, divide, round, multiply) is part of the result."""
    eff = patch * merge
    scale = F.lit(float(target)) / col_(longest).cast("double")
    return F.greatest(F.lit(eff).cast("bigint"),
                      (F.bround(col_(side).cast("double") * scale / F.lit(float(eff)), 0)
                       * F.lit(eff)).cast("bigint"))


def resize_plan(w, h, target: int = K.TARGET_SIZE) -> tuple[Column, Column]:
    longest = F.greatest(col_(w), col_(h))
    return resize_side(w, longest, target), resize_side(h, longest, target)


def patch_grid(w, h, patch: int = K.PATCH_SIZE) -> tuple[Column, Column, Column]:
    """Grid (t, h, w) of patches."""
    return F.lit(1).cast("bigint"), F.floor(col_(h) / patch).cast("bigint"), \
        F.floor(col_(w) / patch).cast("bigint")


def num_image_tokens(w, h, patch: int = K.PATCH_SIZE, merge: int = K.SPATIAL_MERGE) -> Column:
    """``(h // p // m) * (w // p // m)``."""
    hh = F.floor(F.floor(col_(h) / patch) / merge)
    ww = F.floor(F.floor(col_(w) / patch) / merge)
    return (hh * ww).cast("bigint")


def lr_factor(step, warmup: int, total: int, clamp: bool = False) -> Column:
    """Linear warm-up then half cosine with floor 0 (G5).  Progress is not
    clamped past the end unless ``clamp``, so the factor rises again."""
    s = col_(step).cast("double")
    warm = s / F.lit(float(max(1, warmup)))
    progress = (s - F.lit(float(warmup))) / F.lit(float(max(1, total - warmup)))
    if clamp:
        progress = F.least(progress, F.lit(1.0))
    cosine = F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    return F.when(s < F.lit(float(warmup)), warm).otherwise(cosine)


def rate(n, seconds) -> Column:
    """``n / seconds`` with 0 when no time elapsed."""
    s = col_(seconds).cast("double")
    return F.when(s > 0, col_(n).cast("double") / s).otherwise(F.lit(0.0))
