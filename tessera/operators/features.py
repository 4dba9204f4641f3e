"""Model-side operators that must run user numerics.

Both run as ``mapInPandas``: one Arrow batch at a time, numpy inside, the
weights or the encoder built once per task.  Catalyst does not push filters
below a Python stage, so callers filter first (the operators do not).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import constants as K
from tessera.functions import geometry as GE

# erf on a grid, between whose points cubic Hermite interpolation is exact to about 1e-12
_STEP, _END = 1 / 512, 6.0
_GRID = np.arange(-_END, _END + _STEP, _STEP)
_VALUE = np.array([math.erf(v) for v in _GRID])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_GRID ** 2) * _STEP


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of each element, vectorised, in float64."""
    at = (np.clip(x, -_END, _END - _STEP).astype(np.float64) + _END) / _STEP
    i = at.astype(np.int64)
    t = at - i
    a, b, da, db = _VALUE[i], _VALUE[i + 1], _SLOPE[i], _SLOPE[i + 1]
    return a + t * (da + t * (3 * (b - a) - 2 * da - db + t * (2 * (a - b) + da + db)))


def gelu_erf(x: np.ndarray) -> np.ndarray:
    """GELU in its exact (erf) form."""
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)).astype(x.dtype))


def mlp_project(x: np.ndarray, w1, b1, w2, b2) -> np.ndarray:
    """Linear -> GELU -> Linear, plus the input when dimensions match."""
    h = gelu_erf(x @ w1.T + b1)
    out = h @ w2.T + b2
    if x.shape[1] == out.shape[1]:
        out = out + x
    return out


def project_embeddings(df: DataFrame, col: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray,
                       b2: np.ndarray, out: str = "projected") -> DataFrame:
    """MLP projection of an embedding column.  The weights are a fixed,
    known-size set (hidden x in + hidden x hidden floats), shipped once with
    the function; one matmul per Arrow batch."""
    sc = df.sparkSession.sparkContext
    bw = sc.broadcast((w1.astype(np.float32), b1.astype(np.float32), w2.astype(np.float32), b2.astype(np.float32)))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a1, c1, a2, c2 = bw.value
        for pdf in batches:
            if len(pdf) == 0:
                pdf[out] = []
                yield pdf
                continue
            x = np.stack(pdf[col].map(lambda v: np.asarray(v, dtype=np.float32)).to_numpy())
            y = mlp_project(x, a1, c1, a2, c2).astype(np.float32)
            pdf[out] = list(y)
            yield pdf

    return df.mapInPandas(run, schema)


Encoder = Callable[[pd.DataFrame], list[np.ndarray]]


def extract_features(df: DataFrame, make_encoder: Callable[[], Encoder], out: str = "feature",
                     patches_col: str = "num_patches", per_patch: bool = False,
                     keep: list[str] | None = None) -> DataFrame:
    """Batch feature extraction with a user-supplied encoder.
    ``make_encoder()`` runs once per task (model load); the encoder maps a
    pandas batch to one ``[num_patches, dim]`` array per row.  Values are
    rounded through fp16 like the cache (stored as FLOAT: Spark has no half
    type).

    ``per_patch`` emits one row per patch (``patch_idx``, ``out`` of one
    patch's ``dim`` values), the cache's row shape: rows stay ``dim`` wide
    instead of ``num_patches * dim``, and the alignment join (J2) can key
    on (id, patch).  ``keep`` names the input columns carried to the
    output (default: all); in per-patch mode pass the id only, or every
    patch row would repeat the encoder's input (an image's bytes)."""
    extra = [T.StructField(out, T.ArrayType(T.FloatType())), T.StructField(patches_col, T.IntegerType())]
    if per_patch:
        extra.append(T.StructField("patch_idx", T.IntegerType()))
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    keep_names = [f.name for f in kept]
    schema = T.StructType(kept + extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = make_encoder()
        for pdf in batches:
            feats = enc(pdf) if len(pdf) else []
            half = [np.asarray(f, dtype=np.float16).astype(np.float32) for f in feats]
            counts = [int(h.shape[0]) for h in half]
            if per_patch:
                rep = pdf[keep_names].loc[pdf.index.repeat(counts)].reset_index(drop=True)
                rep[out] = [row for h in half for row in h]
                rep[patches_col] = np.repeat(counts, counts).astype("int32")
                rep["patch_idx"] = np.concatenate([np.arange(c, dtype="int32") for c in counts]) \
                    if counts else np.array([], dtype="int32")
                yield rep
                continue
            res = pdf[keep_names].copy()
            res[out] = [h.reshape(-1) for h in half]
            res[patches_col] = counts
            yield res

    return df.mapInPandas(run, schema)


Processor = Callable[[pd.DataFrame], list[np.ndarray]]


def process_images(df: DataFrame, make_processor: Callable[[], Processor], w: str = "w", h: str = "h",
                   target: int = K.TARGET_SIZE, out: str = "pixels", keep: list[str] | None = None) -> DataFrame:
    """U1, image side: a user-supplied image processor over Arrow batches.

    The geometry is planned here, by expressions (G1-G3): a batch reaches the
    processor with the image bytes and the columns new_w, new_h, grid_h, grid_w
    and n_tokens.  It returns one ``[grid_h * grid_w, dim]`` array per row; any
    other number of patches is an error, as no later stage could align them.
    ``out`` is the array row by row, ARRAY<FLOAT>; ``make_processor()`` runs once
    per task.  ``keep`` names the columns carried on (default: all)."""
    new_w, new_h = GE.resize_plan(w, h, target)
    planned = df.withColumns({"new_w": new_w, "new_h": new_h})
    _, grid_h, grid_w = GE.patch_grid("new_w", "new_h")
    planned = planned.withColumns({"grid_h": grid_h, "grid_w": grid_w, "n_tokens": GE.num_image_tokens("new_w", "new_h")})
    plan = ["new_w", "new_h", "grid_h", "grid_w", "n_tokens"]
    names = [*(keep if keep is not None else df.columns), *plan]
    schema = T.StructType([*(planned.schema[n] for n in names), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = make_processor()
        for pdf in batches:
            patches = process(pdf) if len(pdf) else []
            for n, x in zip(pdf["grid_h"] * pdf["grid_w"], patches, strict=True):
                if len(x) != n:
                    raise ValueError(f"the image processor gave {len(x)} patches where the plan has {n}")
            res = pdf[names].copy()
            res[out] = [np.asarray(x, dtype=np.float32).reshape(-1) for x in patches]
            yield res

    return planned.mapInPandas(run, schema)


def _half_bytes(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(at)
        values = x.flatten().to_numpy(zero_copy_only=False).astype("<f2")
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
        offsets = np.r_[0, 2 * np.cumsum(sizes)].astype(np.int32)
        known = None if not x.null_count else pa.array(x.is_valid()).buffers()[1]
        packed = pa.Array.from_buffers(pa.binary(), len(x), [known, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])
        yield batch.set_column(at, batch.schema.names[at], packed)


def _half_values(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(at)
        values = np.frombuffer(b"".join(v.as_buffer() for v in x if v.is_valid), "<f2").astype(np.float32)
        sizes = pc.fill_null(pc.binary_length(x), 0).to_numpy() // 2
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[~x.is_valid().to_numpy(False), False])
        lists = pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()))
        yield batch.set_column(at, batch.schema.names[at], lists)


def _recoded(df: DataFrame, col: str, to: T.DataType, run) -> DataFrame:
    at = df.columns.index(col)
    schema = T.StructType([T.StructField(f.name, to if f.name == col else f.dataType) for f in df.schema])
    return df.mapInArrow(lambda it: run(it, at), schema)


def pack_half(df: DataFrame, col: str) -> DataFrame:
    """The array ``col`` rounded to half precision (to nearest, ties to even)
    and packed into BINARY, two little-endian bytes a value; null stays null."""
    df = df.withColumn(col, F.col(col).cast("array<double>"))
    return _recoded(df, col, T.BinaryType(), _half_bytes)


def unpack_half(df: DataFrame, col: str) -> DataFrame:
    """``pack_half`` read back as ARRAY<FLOAT>, which holds every half exactly."""
    return _recoded(df, col, T.ArrayType(T.FloatType()), _half_values)
