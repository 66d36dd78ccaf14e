"""Operations on columns as a set: names, positions, patterns, overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def clean_names(df: DataFrame) -> DataFrame:
    """Turn every column name into a unique identifier: odd characters become underscores, a
    leading digit is prefixed, repeats are numbered."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = re.sub(r"[^0-9A-Za-z_]", "_", raw)
        if not name or not re.match(r"[A-Za-z]", name):
            name = "X" + name
        if name in seen:
            seen[name] += 1
            name = f"{name}_{seen[name]}"
        seen.setdefault(name, 0)
        names.append(name)
    return df.toDF(*names)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def name_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from one column to another, both included, in frame order."""
    start, stop = df.columns.index(first), df.columns.index(last)
    return df.columns[start : stop + 1]


def position_range(df: DataFrame, *spans: tuple[int, int]) -> list[str]:
    """Names at 1-based positions, each span with both ends included."""
    return [c for start, stop in spans for c in df.columns[start - 1 : stop]]


def reorder(df: DataFrame, front: Sequence[str]) -> DataFrame:
    """Move the named columns to the front, in the given order."""
    return df.select(*front, *[c for c in df.columns if c not in front])


def apply_to(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: change(F.col(c)) for c in columns})


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per column name of either frame: where it occurs and how many values it holds there."""

    def filled(df: DataFrame, side: str) -> DataFrame:
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        return counts.unpivot([], df.columns, "column_name", f"filled_{side}")

    both = filled(left, "left").join(filled(right, "right"), "column_name", "full")
    return both.select(
        "column_name",
        F.col("filled_left").isNotNull().alias("in_left"),
        F.col("filled_right").isNotNull().alias("in_right"),
        "filled_left",
        "filled_right",
    )
