"""Recoding: value maps, ordered levels, missing-value sentinels, text searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def recode(x: Column, mapping: Mapping, default=None) -> Column:
    """Value map with a default for everything else, NULL included."""
    out = F
    for value, target in mapping.items():
        out = out.when(x == F.lit(value), F.lit(target))
    return out.otherwise(F.lit(default))


def level_number(x: Column, levels: Sequence[str]) -> Column:
    """1-based position in an ordered list of levels; a value outside the list is NULL."""
    out = F
    for number, level in enumerate(levels, start=1):
        out = out.when(x == F.lit(level), F.lit(number))
    return out.otherwise(F.lit(None).cast("int"))


def level_label(number: Column, levels: Sequence[str]) -> Column:
    """Label of a level number; the map is fixed and does not shift when a level is absent."""
    out = F
    for position, level in enumerate(levels, start=1):
        out = out.when(number == position, F.lit(level))
    return out.otherwise(F.lit(None).cast("string"))


def without_sentinel(x: Column, digits: str) -> Column:
    """NULL for a number whose printed form contains `digits` anywhere (so 999 also hits 29990)."""
    return F.when(~x.cast("string").contains(digits), x)


def without_values(x: Column, values: Sequence[str]) -> Column:
    """NULL for the listed values."""
    return F.when(~x.isin(*values), x)


def any_matches(columns: Sequence[Column], pattern: str) -> Column:
    """Does any column, printed as text, contain the pattern? A NULL column does not."""
    hits = [F.coalesce(c.cast("string").rlike(pattern), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)
