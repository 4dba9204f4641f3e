"""GUI action parsing (X1-X4) as column expressions.

The patterns are the fixed action grammar; Python's Unicode ``\\d``/``\\w``/
``\\s`` are spelled out so Java regex (Spark) and RE2 (the SQL oracle) agree
with Python on Indic digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import PY_WS, col_, py_float, py_strip

_NUM = r"([\p{Nd}.]+)"
_SP = PY_WS + "*"

# FIXED VALUES: the action grammar, in match order.
CLICK_RE = r"click\(x=" + _NUM + "," + _SP + "y=" + _NUM + r"\)"
TYPE_RE = r'type\(text="([^"]+)"\)'
SCROLL_RE = r'scroll\(direction="([\p{L}\p{N}_]+)"\)'
DRAG_RE = (r"drag\(startX=" + _NUM + "," + _SP + "startY=" + _NUM + "," + _SP
           + "endX=" + _NUM + "," + _SP + "endY=" + _NUM + r"\)")
LONG_PRESS_RE = r"long_press\(x=" + _NUM + "," + _SP + "y=" + _NUM + r"\)"
DONE_RE = r"done\(\)"

ACTION_FIELDS = ["action_type", "x", "y", "text", "direction",
                 "start_x", "start_y", "end_x", "end_y"]


def _num(t: Column, pattern: str, group: int) -> Column:
    return py_float(F.regexp_extract(t, pattern, group))


def _kind(t: Column) -> Column:
    return (F.when(t.rlike(CLICK_RE), "click")
            .when(t.rlike(TYPE_RE), "type")
            .when(t.rlike(SCROLL_RE), "scroll")
            .when(t.rlike(DRAG_RE), "drag")
            .when(t.rlike(LONG_PRESS_RE), "long_press")
            .when(t.rlike(DONE_RE), "done"))


def _fields(t: Column, kind: Column) -> Column:
    dnull = F.lit(None).cast("double")
    snull = F.lit(None).cast("string")
    x = (F.when(kind == "click", _num(t, CLICK_RE, 1))
         .when(kind == "long_press", _num(t, LONG_PRESS_RE, 1)).otherwise(dnull))
    y = (F.when(kind == "click", _num(t, CLICK_RE, 2))
         .when(kind == "long_press", _num(t, LONG_PRESS_RE, 2)).otherwise(dnull))
    is_drag = kind == "drag"
    s = F.struct(
        kind.alias("action_type"), x.alias("x"), y.alias("y"),
        F.when(kind == "type", F.regexp_extract(t, TYPE_RE, 1)).otherwise(snull).alias("text"),
        F.when(kind == "scroll", F.regexp_extract(t, SCROLL_RE, 1)).otherwise(snull).alias("direction"),
        F.when(is_drag, _num(t, DRAG_RE, 1)).otherwise(dnull).alias("start_x"),
        F.when(is_drag, _num(t, DRAG_RE, 2)).otherwise(dnull).alias("start_y"),
        F.when(is_drag, _num(t, DRAG_RE, 3)).otherwise(dnull).alias("end_x"),
        F.when(is_drag, _num(t, DRAG_RE, 4)).otherwise(dnull).alias("end_y"),
    )
    return F.when(kind.isNotNull(), s)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
    (a one-element ``transform``): the text and the kind are referenced by
    every field and would otherwise be recomputed for each reference."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_action(c) -> Column:
    """First match in the fixed order click, type, scroll, drag, long_press,
    done (unanchored); null when nothing matches (X1).  Column form, used
    per line inside X2; on a whole DataFrame prefer
    ``operators.actions.parse_action_df`` (whole-stage codegen)."""
    return _bind(py_strip(col_(c)), lambda t: _bind(_kind(t), lambda k: _fields(t, k)))


def parse_actions(c) -> Column:
    """All actions of a text, at most one per line, misses dropped."""
    lines = F.split(py_strip(col_(c)), "\n", -1)
    return F.filter(F.transform(lines, parse_action), lambda a: a.isNotNull())


def coordinate_error(a) -> Column:
    """Reject reason for an action whose numbers did not parse: Python's
    ``float`` would raise on them (e.g. ``1.2.3``)."""
    a = col_(a)
    t = a["action_type"]
    bad_xy = t.isin("click", "long_press") & (a["x"].isNull() | a["y"].isNull())
    bad_drag = (t == "drag") & (a["start_x"].isNull() | a["start_y"].isNull()
                                | a["end_x"].isNull() | a["end_y"].isNull())
    return F.when(bad_xy | bad_drag, F.lit("unparseable coordinate"))


def split_thought(c) -> tuple[Column, Column]:
    """Inverse of the thought-action target (X3): the ``<think>`` body and the
    text with the block removed, stripped."""
    c = col_(c)
    pat = r"(?s)<think>(.*?)</think>"
    has = c.rlike(pat)
    thought = F.when(has, F.regexp_extract(c, pat, 1))
    rest = py_strip(F.regexp_replace(c, pat, ""))
    return thought, rest


def in_unit(v) -> Column:
    return v.isNull() | v.between(0.0, 1.0)


def validate_action(a) -> Column:
    """Known action type and every coordinate within [0, 1]."""
    a = col_(a)
    known = a["action_type"].isin(*K.ACTION_TYPES)
    coords = [a[f] for f in ("x", "y", "start_x", "start_y", "end_x", "end_y")]
    ok = known
    for v in coords:
        ok = ok & in_unit(v)
    return F.coalesce(ok & coordinate_error(a).isNull(), F.lit(False))
