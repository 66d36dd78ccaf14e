"""Ordered cleaning rules and user-supplied corrections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.operators.joins import salted_join
from kinsieve.operators.ordered import Order, order_struct


@dataclass(frozen=True)
class Rule:
    """Set `column` to `value` where `when` holds; a NULL condition changes nothing."""

    column: str
    when: Column
    value: object


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Apply rules strictly in order: a later rule sees, and may overwrite, what an earlier one wrote."""
    for rule in rules:
        value = rule.value if isinstance(rule.value, Column) else F.lit(rule.value)
        old = F.col(rule.column) if rule.column in df.columns else F.lit(None)
        df = df.withColumn(rule.column, F.when(rule.when, value).otherwise(old))
    return df


def apply_corrections(
    df: DataFrame,
    corrections: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: Sequence[Order | str],
    hot: list | None = None,
) -> DataFrame:
    """Apply a corrections table with rows (key, column_name, new_value as text).

    The last correction of a (key, column) in `order_by` wins; a correction to NULL empties the cell.
    """
    rank = order_struct(corrections, order_by)
    wide = corrections.groupBy(key).agg(
        *[
            F.max_by(F.struct(F.col("new_value").alias("v")), F.when(F.col("column_name") == c, rank)).alias(f"__fix{i}")
            for i, c in enumerate(columns)
        ]
    )
    joined = salted_join(df, wide, [key], "left", hot)
    fixed = {}
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        fixed[c] = F.when(F.col(f"__fix{i}").isNotNull(), F.col(f"__fix{i}")["v"].try_cast(kind)).otherwise(F.col(c))
    return joined.withColumns(fixed).select(*df.columns)
