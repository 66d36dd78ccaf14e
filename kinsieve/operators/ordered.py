"""Ordered analytics without a single-partition window and without a hot partition.

A frame is range-partitioned into buckets of neighbouring rows in (group, order) order and written once, so
that every later step sees the same buckets. A group that holds a large share of all rows is cut into several
buckets. Inside a bucket a normal window does the work. A group that runs over a border receives what lies
before (or behind) it from a carry table that has at most two rows per bucket.

The order must be complete (end it with a unique row key): equal keys always share a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kinsieve.operators.quantiles import exact_quantiles as exact_quantiles
from kinsieve.session import written, written_and_counted

ROWS_PER_BUCKET = 100_000
# as many tasks as a large cluster keeps busy; with more rows buckets hold more of them, and windows spill
TASKS = 20_000
# carry tables have at most two rows per bucket; up to here that is known to be small enough to broadcast
BROADCAST_BUCKETS = 100_000

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Order:
    """One sort column; a missing value sorts first unless stated otherwise."""

    column: str
    descending: bool = False
    nulls_first: bool = True

    def reversed(self) -> "Order":
        return Order(self.column, not self.descending, not self.nulls_first)

    def expression(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def asc(column: str, nulls_first: bool = True) -> Order:
    return Order(column, False, nulls_first)


def desc(column: str, nulls_first: bool = False) -> Order:
    return Order(column, True, nulls_first)


def as_orders(order_by: Sequence[Order | str]) -> list[Order]:
    return [o if isinstance(o, Order) else asc(o) for o in order_by]


def sort_expressions(order_by: Sequence[Order | str]) -> list[Column]:
    return [o.expression() for o in as_orders(order_by)]


def order_struct(df: DataFrame, order_by: Sequence[Order | str]) -> Column:
    """One struct whose natural ascending order equals the wanted order."""
    fields = []
    for i, order in enumerate(as_orders(order_by)):
        c = F.col(order.column)
        missing = F.isnull(c)
        fields.append((~missing if order.nulls_first else missing).alias(f"n{i}"))
        fields.append((_reversed(c, df.schema[order.column].dataType) if order.descending else c).alias(f"v{i}"))
    return F.struct(*fields)


def _reversed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return -c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.StringType):
        # complement of the UTF-8 bytes; the closing G sorts a longer string before its own prefix
        return F.concat(F.translate(F.hex(F.encode(c, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    raise TypeError(f"cannot sort {kind} in descending order")


class OrderedFrame:
    """A frame cut along (group, order); every method adds columns to `frame`."""

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[Order | str],
        partition_by: Sequence[str] = (),
        rows_per_bucket: int | None = None,
        rows: int | None = None,
    ):
        self.groups = list(partition_by)
        self.orders = as_orders(order_by)
        self.rows = rows = df.count() if rows is None else rows
        size = rows_per_bucket or max(ROWS_PER_BUCKET, rows // TASKS)
        self.buckets = max(1, math.ceil(rows / size))
        if self.buckets > 1:
            # group columns lead, so a bucket holds whole groups apart from the ones at its two ends
            along = [asc(g).expression() for g in self.groups] + [o.expression() for o in self.orders]
            ranges = df.repartitionByRange(self.buckets, *along).withColumn(_BUCKET, F.spark_partition_id())
            df = written(ranges, "ranges")
        else:
            df = df.withColumn(_BUCKET, F.lit(0))
        self.base = self.frame = df

    def _local(self) -> Window:
        return Window.partitionBy(_BUCKET, *self.groups)

    def _ordered(self, backward: bool = False) -> Window:
        orders = [o.reversed() if backward else o for o in self.orders]
        window = self._local().orderBy(*[o.expression() for o in orders])
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _pieces(self, df: DataFrame) -> DataFrame:
        """The rows of groups that run over a border (every row when there are no groups)."""
        if not self.groups:
            return df
        # such a group is the last of one bucket and the first of another
        whole = F.struct(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(self.groups)])
        ends = self.base.groupBy(_BUCKET).agg(F.array(F.min(whole), F.max(whole)).alias("__ends"))
        names = [f"__g{i}" for i in range(len(self.groups))]
        ends = ends.select(_BUCKET, F.inline("__ends"))
        split = ends.groupBy(*names).agg((F.min(_BUCKET) < F.max(_BUCKET)).alias("__over")).filter("__over").select(*names)
        same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(self.groups, names)]
        return df.join(self._small(split), same, "left_semi")

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.buckets <= BROADCAST_BUCKETS else df

    def _attach(self, carry: DataFrame, names: list[str]) -> DataFrame:
        renamed = carry.select(
            F.col(_BUCKET).alias("__b"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(self.groups)], *names
        )
        same = [F.col(_BUCKET) == F.col("__b")]
        same += [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(self.groups)]
        joined = self.frame.join(self._small(renamed), same, "left")
        return joined.drop("__b", *[f"__g{i}" for i in range(len(self.groups))])

    def _across(self) -> Window:
        """Window over the carry table: at most two rows per bucket in all."""
        return Window.partitionBy(*self.groups) if self.groups else Window.partitionBy(F.lit(0))

    def running_sum(self, value: Column, name: str, total: str | None = None) -> "OrderedFrame":
        """Sum of `value` from the start of the group to this row; `total` adds the sum of the group."""
        self.frame = self.frame.withColumn("__value", value)
        sums = [F.sum("__value").over(self._ordered()).alias("__sum")]
        if total:
            sums.append(F.sum("__value").over(self._local()).alias("__all"))
        self.frame = self.frame.select("*", *sums)
        before, whole = F.lit(0), F.col("__all") if total else None
        if self.buckets > 1:
            pieces = self._pieces(self.base.withColumn("__value", value))
            pieces = pieces.groupBy(_BUCKET, *self.groups).agg(F.sum("__value").alias("__piece"))
            earlier = self._across().orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
            carry = pieces.select(
                _BUCKET,
                *self.groups,
                F.sum("__piece").over(earlier).alias("__before"),
                F.sum("__piece").over(self._across()).alias("__whole"),
            )
            self.frame = self._attach(carry, ["__before", "__whole"])
            before, whole = F.coalesce("__before", F.lit(0)), F.coalesce("__whole", "__all") if total else None
        added = {name: F.col("__sum") + before} | ({total: whole} if total else {})
        self.frame = self.frame.withColumns(added).drop("__value", "__sum", "__all", "__before", "__whole")
        return self

    def index(self, name: str, total: str | None = None) -> "OrderedFrame":
        """1-based row number within the group; `total` adds the number of rows of the group."""
        return self.running_sum(F.lit(1).cast("long"), name, total)

    def filled(self, fills: Mapping[str, tuple[str, bool]]) -> "OrderedFrame":
        """Last known value at or before each row, or next known one at or after it: {name: (column, backward)}.

        All columns share one carry table and one window per direction. Backward is forward in the opposite
        order: a frame that ends at the partition's end would be evaluated anew for every row.
        """
        last = lambda c, window: F.last(c, ignorenulls=True).over(window)
        names = {name: f"__k{i}" for i, name in enumerate(fills)}
        self.frame = self.frame.select("*", *[last(c, self._ordered(back)).alias(n) for n, (c, back) in fills.items()])
        if self.buckets == 1:
            return self
        order = order_struct(self.base, self.orders)
        edges = []
        for name, (column, back) in fills.items():
            known = F.when(F.col(column).isNotNull(), order)
            edges.append((F.min_by if back else F.max_by)(column, known).alias(names[name]))
        edges = self._pieces(self.base).groupBy(_BUCKET, *self.groups).agg(*edges)
        carried = []
        for name, (_, back) in fills.items():
            across = self._across().orderBy(F.col(_BUCKET).desc() if back else F.col(_BUCKET))
            carried.append(last(names[name], across.rowsBetween(Window.unboundedPreceding, -1)).alias(names[name]))
        self.frame = self._attach(edges.select(_BUCKET, *self.groups, *carried), list(names.values()))
        self.frame = self.frame.withColumns({n: F.coalesce(n, k) for n, k in names.items()}).drop(*names.values())
        return self

    def result(self) -> DataFrame:
        return self.frame.drop(_BUCKET)


def with_index(df, order_by, partition_by=(), name="row_index", total=None, rows_per_bucket=None) -> DataFrame:
    """Add the row number within each group."""
    return OrderedFrame(df, order_by, partition_by, rows_per_bucket).index(name, total).result()


def with_running_sum(
    df, value: str, order_by, partition_by=(), name="running", total=None, rows_per_bucket=None
) -> DataFrame:
    """Add a prefix sum within each group."""
    ordered = OrderedFrame(df, order_by, partition_by, rows_per_bucket)
    return ordered.running_sum(F.col(value), name, total).result()


def fill_missing(df, columns, order_by, partition_by=(), both_ways=False, rows_per_bucket=None) -> DataFrame:
    """Carry the last known value forward; `both_ways` then fills leading gaps from the next known one."""
    fills = {f"__fwd{i}": (c, False) for i, c in enumerate(columns)}
    if both_ways:
        fills |= {f"__bwd{i}": (c, True) for i, c in enumerate(columns)}
    out = OrderedFrame(df, order_by, partition_by, rows_per_bucket).filled(fills).result()
    ways = ("fwd", "bwd") if both_ways else ("fwd",)
    filled = {c: F.coalesce(*[f"__{way}{i}" for way in ways]) for i, c in enumerate(columns)}
    return out.withColumns(filled).drop(*fills)


def every_kth(df, k: int, order_by, first_share: float = 1.0, rows_per_bucket=None) -> DataFrame:
    """Systematic sample: rows 1, 1+k, 1+2k, ... of the sorted frame, up to a leading share of it."""
    out = with_index(df, order_by, name="__i", total="__n", rows_per_bucket=rows_per_bucket)
    wanted = (F.pmod(F.col("__i") - 1, F.lit(k)) == 0) & (F.col("__i") <= F.col("__n") * F.lit(first_share))
    return out.filter(wanted).drop("__i", "__n")


def value_counts(df: DataFrame, column: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Distinct non-missing values with their counts (pre-aggregates ties before anything is ordered), and
    how many there are.

    The counts are read several times, so they are written once; what lies behind `df` is computed once.
    """
    known = df.filter(F.col(column).isNotNull())
    return written_and_counted(known.groupBy(*partition_by, column).agg(F.count("*").alias("__n")), "value-counts")


def average_ranks(
    df: DataFrame,
    column: str,
    name: str = "rank",
    descending: bool = False,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Distinct values with the average rank their rows share."""
    counts, size = value_counts(df, column, partition_by)
    ordered = OrderedFrame(counts, [Order(column, descending)], partition_by, rows_per_bucket, size)
    ranked = ordered.running_sum(F.col("__n"), "__upto").result()
    rank = F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0)
    return ranked.select(*partition_by, column, rank.alias(name))


def step_distribution(
    df: DataFrame, column: str, partition_by: Sequence[str] = (), rows_per_bucket: int | None = None
) -> DataFrame:
    """Full empirical distribution: one row per distinct value with the share of rows at or below it."""
    counts, size = value_counts(df, column, partition_by)
    ordered = OrderedFrame(counts, [asc(column)], partition_by, rows_per_bucket, size)
    cumulated = ordered.running_sum(F.col("__n"), "__upto", "__total").result()
    return cumulated.select(
        *partition_by, column, F.col("__n").alias("n"), (F.col("__upto") / F.col("__total")).alias("share")
    )
