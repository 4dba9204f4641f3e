"""Token, mask and label arrays (T3-T10) as higher-order array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import col_


def attention_mask(ids) -> Column:
    """All ones, one per token."""
    return F.array_repeat(F.lit(1).cast("tinyint"), F.size(col_(ids)))


def image_mask(ids, n_prompt=None, image_token_id: int = K.IMAGE_TOKEN_ID) -> Column:
    """Image-token mask (T4).  With ``n_prompt`` the answer part is forced
    false (live path); without it the whole sequence counts (cache path)."""
    ids = col_(ids)
    if n_prompt is None:
        return F.transform(ids, lambda t: t == F.lit(image_token_id))
    n = col_(n_prompt)
    return F.transform(ids, lambda t, i: (t == F.lit(image_token_id)) & (i < n))


def mask_labels(ids, n_prompt, ignore: int = K.IGNORE_INDEX) -> Column:
    """Prompt positions become the ignore index, answer ids stay (T5)."""
    n = col_(n_prompt)
    return F.transform(col_(ids), lambda t, i: F.when(i < n, F.lit(ignore)).otherwise(t))


def truncate(arr, max_length: int) -> Column:
    """Right truncation to ``max_length`` elements."""
    return F.slice(col_(arr), 1, max_length)


def count_true(mask) -> Column:
    """Number of true entries of a boolean mask."""
    return F.size(F.filter(col_(mask), lambda x: x))


def count_supervised(labels, ignore: int = K.IGNORE_INDEX) -> Column:
    return F.size(F.filter(col_(labels), lambda x: x != F.lit(ignore)))


def normalize_output(input_ids, output_ids) -> Column:
    """If the output is not longer than the input, it holds only new tokens:
    prepend the input so a prompt-length slice works on both shapes (T10)."""
    inp, out = col_(input_ids), col_(output_ids)
    return F.when(F.size(out) < F.size(inp) + 1, F.concat(inp, out)).otherwise(out)


def new_tokens(output_ids, n_prompt) -> Column:
    """Tokens after the prompt (T9); empty when nothing was generated."""
    out, n = col_(output_ids), col_(n_prompt)
    return F.when(F.size(out) > n, F.slice(out, n + 1, F.size(out) - n)) \
        .otherwise(F.array().cast("array<int>"))


def ids_to_text(ids) -> Column:
    """Comma-separated rendering of an id array (stable across engines)."""
    return F.array_join(F.transform(col_(ids), lambda x: x.cast("string")), ",")
