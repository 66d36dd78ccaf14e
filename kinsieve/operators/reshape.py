"""Set operations, reshaping and string aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.operators.joins import salted_join
from kinsieve.operators.ordered import asc, with_running_sum


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack frames of equal columns, each row marked with the name of its part."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def union_fill(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def missing_items(lists: DataFrame, known: DataFrame, list_column: str, item: str) -> DataFrame:
    """Items of each named list that the known items do not contain."""
    return salted_join(lists.select(list_column, item), known.select(item).distinct(), [item], "left_anti")


def pivot_wide(df: DataFrame, ids: Sequence[str], names: str, values: Sequence | None, value: Column) -> DataFrame:
    """Long to wide over a stated list of names; an absent cell is NULL.

    `value` is an aggregate, so several rows per cell are settled explicitly. Without a list (None) one more job
    finds the names, in ascending order; more than `spark.sql.pivotMaxValues` of them are an error, as each is a column.
    """
    grouped = df.groupBy(*ids)
    return (grouped.pivot(names) if values is None else grouped.pivot(names, list(values))).agg(value)


def unpivot_long(
    df: DataFrame, ids: Sequence[str], measures: Sequence[str], names: str = "variable", values: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(measures), names, values)


def unpivot_groups(
    df: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]], position: str = "position"
) -> DataFrame:
    """Wide to long for parallel column groups, e.g. {'kind': [kind_1, kind_2], 'mail': [mail_1, mail_2]}."""
    lengths = {len(cols) for cols in groups.values()}
    if len(lengths) != 1:
        raise ValueError("column groups must have equal lengths")
    rows = [
        F.struct(F.lit(i + 1).alias(position), *[F.col(cols[i]).alias(name) for name, cols in groups.items()])
        for i in range(lengths.pop())
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def string_agg(df: DataFrame, keys: Sequence[str], item: str, name: str, separator: str = ", ") -> DataFrame:
    """All non-missing items of a group in one string, sorted, repeats kept.

    Items are counted before the shuffle, so a group with a billion equal items ships one row per task;
    only the cell that is asked for grows with the group.
    """
    counted = df.groupBy(*keys, item).agg(F.count(item).alias("__n"))
    known = F.when(F.col(item).isNotNull(), F.struct(F.col(item).cast("string").alias("v"), F.col("__n").cast("int").alias("n")))
    bags = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(known)).alias("__bag"))
    spelled = F.flatten(F.transform("__bag", lambda p: F.array_repeat(p["v"], p["n"])))
    return bags.select(*keys, F.when(F.size("__bag") > 0, F.array_join(spelled, separator)).alias(name))


def string_agg_chunks(
    df: DataFrame, keys: Sequence[str], item: str, name: str, separator: str = ", ", most: int = 1 << 20, rows_per_bucket: int | None = None
) -> DataFrame:
    """`string_agg` for groups of any size: the string in chunks of about `most` characters, numbered from 0 by `chunk`.

    Joined in order with the separator, a group's chunks are its cell. A running sum of lengths over the ordered (item, count)
    pairs tells the chunk of every copy, so neither a group nor an item with very many copies meets in one task. A
    number is left out where one item is longer than a chunk; a group without items has no rows.
    """
    text = F.col(item).cast("string")
    counted = df.filter(F.col(item).isNotNull()).groupBy(*keys, text.alias("__item")).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__unit", (F.length("__item") + len(separator)).cast("long"))
    if not separator:
        counted = counted.filter(F.col("__unit") > 0)
    placed = with_running_sum(
        counted.withColumn("__size", F.col("__unit") * F.col("__n")), "__size", [asc("__item")], keys, "__end", rows_per_bucket=rows_per_bucket
    ).withColumn("__begin", (F.col("__end") - F.col("__size")).cast("long"))
    begin, unit, n = F.col("__begin"), F.col("__unit"), F.col("__n")
    number = lambda at: F.floor(at / F.lit(most)).cast("long")
    spread = placed.select(*keys, "__item", unit, n, begin, F.explode(F.sequence(number(begin), number(begin + (n - 1) * unit))).alias("chunk"))
    # the first copy at or behind a place
    copy = lambda place: F.greatest(F.lit(0), F.least(n, F.ceil((place - begin) / unit)))
    copies = (copy((F.col("chunk") + 1) * most) - copy(F.col("chunk") * most)).cast("int")
    held = spread.select(*keys, "chunk", F.struct(F.col("__item").alias("v"), copies.alias("n")).alias("__part")).filter("__part.n > 0")
    bags = held.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("__part")).alias("__bag"))
    spelled = F.flatten(F.transform("__bag", lambda p: F.array_repeat(p["v"], p["n"])))
    return bags.select(*keys, "chunk", F.array_join(spelled, separator).alias(name))
