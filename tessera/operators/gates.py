"""Predicates and quality gates.

All gates are plain ``where`` clauses on built-in expressions, so Catalyst
pushes them under projections and into the parquet scan where the column is
a scan column.  They are meant to run before any Python stage (which stops
pushdown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col_, is_blank
from tessera.session import landed


def require_asset(df: DataFrame, ref_col: str, is_array: bool = False) -> DataFrame:
    """Asset present (F1); for a list of images the first one must be."""
    r = col_(ref_col)
    if is_array:
        r = F.get(r, 0)
    return df.where(r.isNotNull())


def require_assistant(df: DataFrame, col: str = "assistant") -> DataFrame:
    """Non-empty assistant text (F2): null and '' both dropped."""
    return df.where(~is_blank(col))


def require_qa(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Non-empty question and answer."""
    return df.where(~is_blank(question) & ~is_blank(answer))


def require_target(df: DataFrame, instruction: str = "instruction", target: str = "target") -> DataFrame:
    """Non-empty instruction and target, tested *before* stripping (F4), so a
    whitespace-only target survives and becomes ''."""
    return df.where(~is_blank(instruction) & ~is_blank(target))


def require_target_variant(df: DataFrame, instruction: str = "instruction", target: str = "target") -> DataFrame:
    """F4 on a target of any JSON type: null, "", 0, false, {} and [] are
    empty; a blank string is not."""
    return df.where(~is_blank(instruction) & ~is_empty_variant(target))


def is_empty_variant(target) -> Column:
    v = col_(target)
    return v.isNull() | F.to_json(v).rlike(r'^(null|""|-?0(\.0*)?(E-?\d+)?|false|\{\}|\[\])$')


def check_alignment(df: DataFrame, count_col: str, expected_col: str, mode: str = "drop") -> DataFrame:
    """Placeholder count must equal the feature count (F5): drop the row
    (cache path) or fail the job (model / processor path)."""
    ok = col_(count_col) == col_(expected_col)
    if mode == "drop":
        return df.where(ok)
    if mode == "fail":
        # a predicate, not a dropped column: column pruning would remove it
        return df.where(F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("image token count mismatch: "), col_(count_col).cast("string"),
                                   F.lit(" != "), col_(expected_col).cast("string")))))
    raise ValueError(mode)


def quarantine(df: DataFrame, reasons: list[tuple[str, Column]],
               reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Row-level quarantine (F6): the first failing check names the reject
    reason; rows without one are good.  Both outputs come from one tagged
    plan (persist it upstream if both are consumed)."""
    r = None
    for name, bad in reasons:   # one flat CASE WHEN: first failing check wins
        cond = F.coalesce(bad, F.lit(True))
        r = F.when(cond, F.lit(name)) if r is None else r.when(cond, F.lit(name))
    tagged = df.withColumn(reason_col, r)
    return tagged.where(F.col(reason_col).isNull()).drop(reason_col), \
        tagged.where(F.col(reason_col).isNotNull())


def quarantine_written(df: DataFrame, reasons: list[tuple[str, Column]],
                       reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """F6 in one pass: ``df`` is evaluated once, written in two folders by
    whether a check fails, and read back as two tables; a read of one never
    opens the other's files."""
    case = None
    for name, bad in reasons:
        cond = F.coalesce(bad, F.lit(True))
        case = F.when(cond, F.lit(name)) if case is None else case.when(cond, F.lit(name))
    tagged = df.withColumn(reason_col, case).withColumn("_rejected", F.col(reason_col).isNotNull())
    both = landed(tagged, "quarantine", partition_by="_rejected")
    return (both.where(~F.col("_rejected")).drop("_rejected", reason_col), both.where("_rejected").drop("_rejected"))
