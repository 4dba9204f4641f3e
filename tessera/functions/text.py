"""Python-exact text rules as Spark column expressions.

Python's ``str.strip()`` removes all Unicode whitespace, Spark's ``trim``
removes only spaces; Python regex ``\\d``/``\\w`` are Unicode-aware, Java's are
not.  These helpers centralise the exact rules so every operator uses them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters Python's str.isspace() accepts (ASCII controls, NEL, separators).
# The same class is valid in Java regex and RE2 (used by the SQL oracle).
PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
STRIP_RE = f"^{PY_WS}+|{PY_WS}+\\z"

# Python \d and \w are Unicode-aware; spelled out so Java and RE2 agree.
PY_DIGIT = r"\p{Nd}"
PY_WORD = r"[\p{L}\p{N}_]"

# Decimal digits of the scripts float() must read, built from the code point
# of each script's zero.  ASCII, Arabic-Indic, extended Arabic-Indic,
# Devanagari, Bengali, Gurmukhi, Gujarati, Oriya, Tamil, Telugu, Kannada,
# Malayalam, fullwidth.
_DIGIT_ZEROS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66,
                0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0xFF10]
UNICODE_DIGITS = "".join(chr(z + i) for z in _DIGIT_ZEROS for i in range(10))
ASCII_DIGITS = "0123456789" * len(_DIGIT_ZEROS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.regexp_replace(col_(c), STRIP_RE, "")


def is_blank(c) -> Column:
    """Python falsiness of a string: null or ''. Whitespace is *not* blank."""
    c = col_(c)
    return c.isNull() | (c == F.lit(""))


def strip_placeholder(c, placeholder: str = "<image>") -> Column:
    """Remove every placeholder occurrence, then strip (human turn text)."""
    return py_strip(F.replace(col_(c), F.lit(placeholder), F.lit("")))


def to_ascii_digits(c) -> Column:
    return F.translate(col_(c), UNICODE_DIGITS, ASCII_DIGITS)


def py_float(c) -> Column:
    """``float(s)`` for a ``[digits.]+`` match; null where Python would raise."""
    return to_ascii_digits(c).try_cast(T.DoubleType())


@F.pandas_udf(T.StringType())
def _fixed4(s: pd.Series) -> pd.Series:
    v = s.to_numpy(dtype="float64", na_value=np.nan)
    out = np.char.mod("%.4f", v).astype(object)     # Python's exact %-formatting
    out[np.isnan(v)] = None
    return pd.Series(out, index=s.index)


def py_fixed4(c) -> Column:
    """``f"{x:.4f}"``: exact binary rounding (Java's Formatter differs on ties).

    An Arrow-batched pandas function; it is the one exact number format that
    no built-in reproduces.
    """
    return _fixed4(col_(c).cast(T.DoubleType()))
