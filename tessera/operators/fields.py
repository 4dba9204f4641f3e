"""Field resolution and turn extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import text as TX


def resolve_alias_columns(df: DataFrame, names: list[str], default=None) -> Column:
    """First of ``names`` that exists as a column (P1).  Absence, not null,
    drives the fallback, so the choice is made once from the schema."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def resolve_alias_map(m, names: list[str], default=None) -> Column:
    """First of ``names`` whose key is *present* in map ``m`` (P1).  A
    present null stays null (unlike ``coalesce``)."""
    m = TX.col_(m)
    out = None
    for n in names:   # one flat CASE WHEN in preference order
        has = F.map_contains_key(m, F.lit(n))
        out = F.when(has, F.element_at(m, F.lit(n))) if out is None else out.when(has, F.element_at(m, F.lit(n)))
    return out.otherwise(F.lit(default))


def canonical_target(kind, x=None, y=None, xy=None, text=None) -> Column:
    """Target canonicalisation (P2): a dict (x, y) or a list of >= 2 numbers
    becomes ``click(x=%.4f, y=%.4f)``; anything else is ``str().strip()``.
    A coordinate that is present but null cannot be formatted: the target is
    null, and the row is one to reject (F6)."""
    k = TX.col_(kind)
    fx = TX.py_fixed4
    out = TX.py_strip(TX.col_(text).cast("string")) if text is not None else F.lit(None).cast("string")
    if xy is not None:
        a = TX.col_(xy)
        out = F.when((k == "list") & (F.size(a) >= 2),
                     F.concat(F.lit("click(x="), fx(F.get(a, 0)), F.lit(", y="), fx(F.get(a, 1)),
                              F.lit(")"))).otherwise(out)
    if x is not None:
        out = F.when(k == "dict", F.concat(F.lit("click(x="), fx(TX.col_(x)), F.lit(", y="), fx(TX.col_(y)), F.lit(")"))).otherwise(out)
    return out


def last_turns(df: DataFrame, key: str = "sample_id", order: str = "turn", speaker: str = "speaker",
               value: str = "value", human: str = "human", gpt: str = "gpt",
               default_prompt: str | None = K.DEFAULT_HUMAN_PROMPT, extra_aggs=()) -> DataFrame:
    """Long-form conversations to (human, assistant) per sample.

    The last human turn and the last assistant turn win independently.  The
    human text loses every ``<image>`` and is stripped; with no human turn it
    is ``default_prompt`` (the loaders' "Describe this image.", or "" for the
    cache writer).  A missing assistant turn gives "".
    One aggregation per sample: map-side partial ``max_by`` then a shuffle of
    one small row per sample and map task.
    """
    sp, o, v = F.col(speaker), F.col(order), F.col(value)
    h_raw = F.max_by(v, F.when(sp == human, o))
    a_raw = F.max_by(v, F.when(sp == gpt, o))
    has_h = F.max(F.when(sp == human, F.lit(1)))
    agg = df.groupBy(key).agg(h_raw.alias("_h"), a_raw.alias("_a"), has_h.alias("_has_h"), *extra_aggs)
    h = F.when(F.col("_has_h").isNull(), F.lit(default_prompt)).otherwise(TX.strip_placeholder("_h"))
    a = F.coalesce(TX.py_strip("_a"), F.lit(""))
    return agg.select(key, h.alias("human"), a.alias("assistant"),
                      *[c for c in agg.columns if c not in (key, "_h", "_a", "_has_h")])


def last_turns_array(conv, role_field: str = "from", value_field: str = "value",
                     human: str = "human", gpt: str = "gpt") -> tuple[Column, Column]:
    """Array form of P3: last element of each filtered turn list, null when
    the speaker never talks."""
    c = TX.col_(conv)
    h = F.try_element_at(F.filter(c, lambda t: t[role_field] == human), F.lit(-1))
    a = F.try_element_at(F.filter(c, lambda t: t[role_field] == gpt), F.lit(-1))
    return h[value_field], a[value_field]


def first_qa(texts, user_field: str = "user", assistant_field: str = "assistant") -> tuple[Column, Column]:
    """First question-answer pair only (P6); the rest is ignored.  ``get``
    is null-safe on an empty list under ANSI mode."""
    first = F.get(TX.col_(texts), 0)
    return first[user_field], first[assistant_field]


def qa_pairs(df: DataFrame, key: str = "sample_id", order: str = "turn", speaker: str = "speaker",
             value: str = "value", human: str = "human", gpt: str = "gpt") -> DataFrame:
    """Long form to the multi-QA shape ``texts ARRAY<STRUCT<user,assistant>>``:
    a human turn pairs with the assistant turn right after it."""
    t = df.select(key, order, speaker, value)
    u = t.where(F.col(speaker) == human).select(key, F.col(order).alias("_t"), F.col(value).alias("user"))
    a = t.where(F.col(speaker) == gpt).select(F.col(key).alias("_k"), (F.col(order) - 1).alias("_ta"),
                                              F.col(value).alias("assistant"))
    pairs = u.join(a, (u[key] == a["_k"]) & (u["_t"] == a["_ta"]), "left")
    return pairs.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_t", "user", "assistant"))),
                    lambda s: F.struct(s["user"].alias("user"), s["assistant"].alias("assistant"))
                    ).alias("texts"))


def first_pair(df: DataFrame, key: str = "sample_id", order: str = "turn", speaker: str = "speaker",
               value: str = "value", human: str = "human", gpt: str = "gpt") -> DataFrame:
    """P6 without building the QA list: the first human turn per sample
    (a partial + final ``min_by``), then the assistant turn right after it
    by an equi-join on (sample, turn + 1), whose key is unique per row.
    No group is collected, so a huge conversation is never one array."""
    sp = F.col(speaker)
    first = df.where(sp == human).groupBy(key).agg(
        F.min_by(F.struct(F.col(order).alias("_t"), F.col(value).alias("_q")), F.col(order)).alias("_f"))
    first = first.select(F.col(key).alias("_k"), F.col("_f._t").alias("_t"), F.col("_f._q").alias("question"))
    ans = df.where(sp == gpt).select(F.col(key).alias("_ka"), F.col(order).alias("_ta"), F.col(value).alias("answer"))
    j = first.join(ans, (first["_k"] == ans["_ka"]) & (ans["_ta"] == first["_t"] + 1), "left")
    return j.select(F.col("_k").alias(key), "question", "answer")


def _present(v: Column, key: str) -> Column:
    """Key present in a JSON object (a present null counts as present)."""
    return F.variant_get(v, f"$.{key}", "variant").isNotNull()


def record_field(record, names: list[str]) -> Column:
    """P1 on a record that is one VARIANT: the value of the first of ``names``
    whose key is present (a present null is a value), else null."""
    v, out = TX.col_(record), None
    for n in names:
        value = F.try_variant_get(v, f"$.{n}", "variant")
        out = F.when(_present(v, n), value) if out is None else out.when(_present(v, n), value)
    return out


def _number(v: Column) -> Column:
    """The value of a JSON number (true and false are 1 and 0), else null: text is never read as a number."""
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double")) \
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))


def _first_present(v: Column, names: list[str], default: float = 0.0) -> Column:
    out = None
    for n in names:   # absence, not null, drives the fallback (P1)
        val = _number(F.variant_get(v, f"$.{n}", "variant"))
        out = F.when(_present(v, n), val) if out is None else out.when(_present(v, n), val)
    return out.otherwise(F.lit(default))


def _py_quoted(s: Column) -> Column:
    """``repr`` of a string: quotes as Python chooses them, the usual escapes."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _py_str(v: Column, inner: bool) -> Column:
    """``str()`` of a JSON value that is no object or list: True, False, None
    and numbers as Python writes them; text as it is, or quoted inside a list."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    yes = F.try_variant_get(v, "$", "boolean")
    out = F.when(kind == "BOOLEAN", F.when(yes, "True").otherwise("False")).when(kind == "VOID", "None")
    return out.when(kind == "STRING", _py_quoted(text) if inner else text).otherwise(text)


def canonical_target_variant(v) -> Column:
    """P1 + P2 on a target ingested as VARIANT (``parse_json``): an object
    gives ``click(x=%.4f, y=%.4f)`` from ``x``/``x_norm`` and ``y``/``y_norm``
    (0 when absent); an array of at least two values gives the same from its
    first two; anything else is what ``str()`` gives, stripped (``True``,
    ``['a']``; an object or list inside a short list keeps its JSON text).  A
    coordinate that is no number (null, text, a list)
    gives a null target: a row to reject (F6), as formatting it would fail."""
    v = TX.col_(v)
    shape = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<variant>")
    fx = TX.py_fixed4

    def click(a, b):
        return F.concat(F.lit("click(x="), fx(a), F.lit(", y="), fx(b), F.lit(")"))
    return (F.when(shape.startswith("OBJECT"),
                   click(_first_present(v, ["x", "x_norm"]), _first_present(v, ["y", "y_norm"])))
            .when(shape.startswith("ARRAY") & (F.size(arr) >= 2), click(_number(F.get(arr, 0)), _number(F.get(arr, 1))))
            .when(shape.startswith("ARRAY"), F.concat(F.lit("["), F.coalesce(_py_str(F.get(arr, 0), True), F.lit("None")),
                                                      F.lit("]")))
            .otherwise(TX.py_strip(_py_str(v, False))))
