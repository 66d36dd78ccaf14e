"""Equi-joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.operators.ordered import Order, average_ranks, order_struct

_SALT = "__salt"


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: Sequence | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on same-named columns.

    Whether a side is broadcast is left to its measured size, and partitions that turn out to be skewed, those
    of a missing key among them, are split at run time. Where heavy values of the first key are known
    beforehand, `hot` spreads their rows of `left` over as many salts as there are shuffle partitions and
    repeats the matching rows of `right`, and only those. Salts follow from the row's place in its partition,
    so equal rows are spread as well. `null_safe` makes a missing key equal to a missing key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("swap the sides: only inner, left, left_semi and left_anti are salted")
    on = list(on)
    if how in ("left_semi", "left_anti"):
        # repeats on the right change nothing, yet a key that repeats there would fill one task
        right = right.select(*on).distinct()
    keys = on
    if hot:
        salts = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        listed = F.col(on[0]).isin(*hot)
        place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
        left = left.withColumn(_SALT, F.when(listed, place).otherwise(F.lit(0)))
        copies = F.when(listed, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = right.withColumn(_SALT, F.explode(copies))
        keys = [*on, _SALT]
    if not null_safe:
        return left.join(right, keys, how).drop(_SALT)
    names = {c: f"__r{i}" for i, c in enumerate(keys)}
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    return left.join(right.withColumnsRenamed(names), same, how).drop(_SALT, *names.values())


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Order | str]) -> DataFrame:
    """First row of each key in the given order; state the order down to a unique column.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key with very
    many rows does not fill one task. Rows are sorted by key before that, as whole rows are aggregated.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), order_struct(df, order_by)).alias("__row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def lookup_update(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    columns: Mapping[str, str],
    order_by: Sequence[Order | str] | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Overwrite or add columns from a lookup, in matched rows only.

    `columns` maps target to lookup column. A matched NULL overwrites; unmatched rows keep what they
    had. Where a key has several lookup rows the last one in `order_by` wins; without `order_by` the
    lookup must already be unique.
    """
    on = list(on)
    lookup = lookup.select(*on, *[c for c in dict.fromkeys(columns.values()) if c not in on], *_extra(order_by, on, columns))
    if order_by is not None:
        rest = [c for c in lookup.columns if c not in on]
        last = F.max_by(F.struct(*rest), order_struct(lookup, order_by)).alias("__new")
        lookup = lookup.groupBy(*on).agg(last)
    else:
        lookup = lookup.select(*on, F.struct(*[c for c in lookup.columns if c not in on]).alias("__new"))
    lookup = lookup.withColumn("__hit", F.lit(True))
    joined = salted_join(df, lookup, on, "left", hot)
    updates = {}
    for target, source in columns.items():
        new = F.col("__new")[source]
        old = F.col(target) if target in df.columns else F.lit(None)
        updates[target] = F.when(F.col("__hit"), new).otherwise(old)
    names = df.columns + [t for t in columns if t not in df.columns]
    return joined.withColumns(updates).select(*names)


def _extra(order_by, on, columns) -> list[str]:
    if order_by is None:
        return []
    names = [o.column if isinstance(o, Order) else o for o in order_by]
    return [n for n in dict.fromkeys(names) if n not in on and n not in columns.values()]


def constant_update(df: DataFrame, key: str, keys: Sequence, column: str, value) -> DataFrame:
    """Set one constant in the rows whose key is listed."""
    old = F.col(column) if column in df.columns else F.lit(None)
    return df.withColumn(column, F.when(F.col(key).isin(*keys), F.lit(value)).otherwise(old))


def inherit_from_relative(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    donor: Column,
    receiver: Column,
    donor_order: Sequence[Order | str],
    hot: list | None = None,
) -> DataFrame:
    """Receivers with a missing value take that of their group's donor (first in `donor_order`)."""
    donors = first_per_key(df.filter(donor), [group], donor_order).select(
        group, F.struct(*columns).alias("__donor")
    )
    joined = salted_join(df, donors, [group], "left", hot)
    updates = {
        c: F.when(receiver & F.col(c).isNull(), F.col("__donor")[c]).otherwise(F.col(c)) for c in columns
    }
    return joined.withColumns(updates).select(*df.columns)


def with_average_rank(
    df: DataFrame,
    column: str,
    name: str,
    descending: bool = False,
    partition_by: Sequence[str] = (),
    missing: str = "keep",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add the average rank of a column. `missing`: 'keep' leaves a NULL rank, 'last' ranks NULLs
    behind all values (sharing their average rank)."""
    source = df
    if missing == "last":
        source = df.withColumn("__present", F.isnull(column).cast("int"))
    elif missing != "keep":
        raise ValueError("missing must be 'keep' or 'last'")
    ranks = average_ranks(source, column, name, descending, partition_by, rows_per_bucket)
    joined = salted_join(df, ranks, [column, *partition_by], "left", null_safe=bool(partition_by))
    if missing == "last":
        sizes = source.groupBy(*partition_by).agg(
            F.count(column).alias("__known"), F.sum("__present").alias("__unknown")
        )
        behind = F.col("__known") + (F.col("__unknown") + 1) / F.lit(2.0)
        if partition_by:
            joined = salted_join(joined, sizes.select(*partition_by, behind.alias("__behind")), partition_by, "left", null_safe=True)
        else:
            joined = joined.withColumn("__behind", sizes.select(behind.alias("b")).scalar())
        joined = joined.withColumn(name, F.coalesce(name, "__behind"))
    return joined.select(*df.columns, name)


def with_level_rank(df: DataFrame, column: str, name: str, levels: Sequence[str]) -> DataFrame:
    """Add the average rank of a column of stated levels, in their order; another or a missing value has none.

    The counts of the levels are one aggregate, read as a scalar: nothing is joined, sorted or written.
    """
    counts = df.agg(F.array(*[F.count(F.when(F.col(column) == level, 1)) for level in levels]).alias("counts")).scalar()
    ranked, rank, before = df.withColumn("__counts", counts), F.lit(None).cast("double"), F.lit(0)
    for i, level in enumerate(levels):
        n = F.col("__counts")[i]
        rank = F.when(F.col(column) == level, before + (n + 1) / F.lit(2.0)).otherwise(rank)
        before = before + n
    return ranked.withColumn(name, rank).drop("__counts")
