"""DataFrame-level action parsing.

The column form (``functions.actions.parse_action``) re-evaluates the
stripped text inside every branch; used on a DataFrame, the optimizer
inlines each struct field separately and the generated code grows until
whole-stage codegen gives up.  Here the stripped text and the action kind
are their own projections: Catalyst keeps a non-cheap expression that is
referenced several times in its own projection instead of inlining it, so
each regex runs once per row and the stage compiles.  The parsed fields
come out of a single-row ``inline``, which predicate pushdown cannot cross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import actions as AC
from tessera.functions.text import py_float, py_strip

_FIELDS = AC.ACTION_FIELDS


def parse_action_df(df: DataFrame, col: str, out: str = "action", flat: bool = False) -> DataFrame:
    """Adds the parsed action (X1) as struct ``out`` (or flat columns)."""
    t = df.withColumn("_pa_t", py_strip(F.col(col)))
    tt = F.col("_pa_t")
    kind = (F.when(tt.rlike(AC.CLICK_RE), "click").when(tt.rlike(AC.TYPE_RE), "type")
            .when(tt.rlike(AC.SCROLL_RE), "scroll").when(tt.rlike(AC.DRAG_RE), "drag")
            .when(tt.rlike(AC.LONG_PRESS_RE), "long_press").when(tt.rlike(AC.DONE_RE), "done"))
    k = t.withColumn("_pa_k", kind)
    kk = F.col("_pa_k")
    num = lambda p, i: py_float(F.regexp_extract(tt, p, i))
    dnull, snull = F.lit(None).cast("double"), F.lit(None).cast("string")
    cols = {
        "action_type": kk,
        "x": F.when(kk == "click", num(AC.CLICK_RE, 1)).when(kk == "long_press", num(AC.LONG_PRESS_RE, 1)).otherwise(dnull),
        "y": F.when(kk == "click", num(AC.CLICK_RE, 2)).when(kk == "long_press", num(AC.LONG_PRESS_RE, 2)).otherwise(dnull),
        "text": F.when(kk == "type", F.regexp_extract(tt, AC.TYPE_RE, 1)).otherwise(snull),
        "direction": F.when(kk == "scroll", F.regexp_extract(tt, AC.SCROLL_RE, 1)).otherwise(snull),
        "start_x": F.when(kk == "drag", num(AC.DRAG_RE, 1)).otherwise(dnull),
        "start_y": F.when(kk == "drag", num(AC.DRAG_RE, 2)).otherwise(dnull),
        "end_x": F.when(kk == "drag", num(AC.DRAG_RE, 3)).otherwise(dnull),
        "end_y": F.when(kk == "drag", num(AC.DRAG_RE, 4)).otherwise(dnull),
    }
    names = {f: f"_pa_{f}" for f in _FIELDS}
    # The fields leave through a one-row Generate: a filter on them (e.g.
    # a reject split) cannot be pushed below it, so the regex chain is not
    # substituted into the predicate, which would otherwise outgrow the
    # 64 KB method limit of whole-stage codegen.
    gen = F.inline(F.array(F.struct(*[cols[c].alias(names[c]) for c in _FIELDS])))
    f = k.select("*", gen).drop("_pa_t", "_pa_k")
    if flat:
        return f.select(*[c for c in f.columns if c not in names.values()],
                        *[F.col(names[c]).alias(c) for c in _FIELDS])
    s = F.when(F.col(names["action_type"]).isNotNull(),
               F.struct(*[F.col(names[c]).alias(c) for c in _FIELDS]))
    return f.withColumn(out, s).drop(*names.values())
