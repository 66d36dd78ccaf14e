"""Exact order statistics by selection: histograms that are refined around the wanted positions.

No values are sorted, shuffled or written. A first aggregate counts values in bins whose order is that of the values (a fixed
number of bins per power of two), so its state does not grow with the rows. The bin that holds a wanted position is cut
into equal parts between its least and its greatest value, and what is left in the one part that holds the position is
told apart by value. Each step is one pass with a partial aggregate: a group with a third of all rows is no burden
for any task, and all columns and positions share the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS_PER_OCTAVE = 32
PARTS = 1 << 16
# so many wanted positions of all groups are sent to where the rows are, at some 100 bytes each
BROADCAST_TARGETS = 100_000
# below the logarithm of the least positive double
_FLOOR = 1100


def order_bin(x: Column) -> Column:
    """A whole number that never falls as the (double) value grows; a NaN comes last, as in a sort."""
    size = F.floor((F.log2(F.abs(x)) + _FLOOR) * BINS_PER_OCTAVE)
    size = F.when(F.abs(x) == float("inf"), F.lit(1 << 20)).otherwise(size)
    signed = F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0))
    return F.when(F.isnan(x), F.lit(1 << 21)).otherwise(signed).cast("int")


def _part(x: Column, low: Column, high: Column) -> Column:
    return F.floor((x - low) / (high - low) * PARTS).cast("int")


def at_positions(
    df: DataFrame, column: str, positions: Callable[[Column], Column], keys: Sequence[str] = (), refinements: int = 1
) -> DataFrame:
    """The values at wanted positions of each group's non-missing values in ascending order.

    `positions` turns the number of values of a group into an array of positions (from 0); one that is out of range gives no
    row. Returns the keys, position, total (values of the group), value (double) and below (values that are smaller).
    Missing keys form a group. Each refinement is one more pass that cuts the rows left per position by up to PARTS. With
    keys the positions of the first pass are counted, in a pass of its own: only where groups are very many are rows joined to
    them by a shuffle.
    """
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    rows = df.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(column).cast("double").alias("__x"))
    rows = rows.filter(F.col("__x").isNotNull()).withColumn("__bin", order_bin(F.col("__x")))
    group = list(names.values())
    counts = rows.groupBy(*group, "__bin").agg(*_bin_aggregates())
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = counts.select("*", F.sum("__n").over(whole).alias("total"))
    counts = counts.select("*", (F.sum("__n").over(whole.orderBy("__bin")) - F.col("__n")).alias("below"))
    inside = F.filter(positions(F.col("total")), lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("__n")))
    position = F.explode(inside.cast("array<long>")).alias("position")
    targets = counts.select(*group, "__bin", "total", "below", "__low", "__high", position)
    # without keys there is a row per position; estimates of the plan follow the rows, and would have all of them shuffled
    few = not group or targets.count() <= BROADCAST_TARGETS
    for _ in range(refinements):
        targets = _refined(rows, targets, group, few, _part(F.col("__x"), F.col("__low"), F.col("__high")))
    # told apart by value: the bins are the values
    targets = _refined(rows, targets, group, few, F.col("__x"))
    return targets.select(
        *[F.col(n).alias(k) for k, n in names.items()], "position", "total", F.col("__low").alias("value"), "below"
    )


def _bin_aggregates() -> list[Column]:
    return [F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")]


def _refined(rows: DataFrame, targets: DataFrame, group: list[str], few: bool, part: Column) -> DataFrame:
    """Each target cut down to the part of its bin that holds its position; where one value is left it stays as it is."""
    open_ones = targets.filter(F.col("__low") < F.col("__high"))
    # at most a row per group and position, and few rows lie in its bins
    renamed = {c: f"{c}_r" for c in [*group, "__bin"]}
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()]
    open_ones = open_ones.withColumnsRenamed(renamed)
    found = rows.join(F.broadcast(open_ones) if few else open_ones, same).filter(F.col("__x").between(F.col("__low"), F.col("__high")))
    held = [*group, "__bin", "position", "total", "below"]
    parts = found.groupBy(*held, part.alias("__part")).agg(*_bin_aggregates())
    upto = F.sum("__n").over(Window.partitionBy(*group, "position").orderBy("__part"))
    parts = parts.select("*", (F.col("below") + upto - F.col("__n")).alias("__before"))
    parts = parts.filter((F.col("position") >= F.col("__before")) & (F.col("position") < F.col("__before") + F.col("__n")))
    cut = parts.select(*group, "__bin", "total", F.col("__before").alias("below"), "__low", "__high", "position")
    done = targets.filter(~(F.col("__low") < F.col("__high"))).select(*cut.columns)
    return cut.unionByName(done)


def quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], keys: Sequence[str] = (), refinements: int = 1
) -> DataFrame:
    """Exact quantiles (linear interpolation) of several columns per group, given as {name: (column, probability)}; one row per
    group with any value in any of the columns."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    number = {c: i for i, c in enumerate(columns)}
    target = lambda total, p: (total - 1) * F.lit(float(p))
    if len(columns) == 1:
        long, group = df.select(*keys, F.col(columns[0]).alias("__v")), list(keys)
        of = lambda c: F.lit(True)
        at = lambda total: _neighbours(total, [p for _, p in wanted.values()], target)
    else:
        # every value with the number of its column
        pairs = F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).cast("double").alias("__v")) for c, i in number.items()])
        long, group = df.select(*keys, F.inline(pairs)), [*keys, "__c"]
        of = lambda c: F.col("__c") == number[c]
        probabilities = list(dict.fromkeys(p for _, p in wanted.values()))
        at = lambda total: _neighbours(total, probabilities, target)
    found = at_positions(long, "__v", at, group, refinements)
    picks = []
    for i, (column, p) in enumerate(wanted.values()):
        point = target(F.col("total"), p)
        value = lambda edge: F.max(F.when(of(column) & (F.col("position") == edge(point)), F.col("value")))  # noqa: E731, B023
        picks += [value(F.floor).alias(f"__lo{i}"), value(F.ceil).alias(f"__hi{i}")]
        picks.append(F.max(F.when(of(column), point - F.floor(point))).alias(f"__part{i}"))
    picked = found.groupBy(*keys).agg(*picks)
    between = [
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__part{i}")).alias(name)
        for i, name in enumerate(wanted)
    ]
    return picked.select(*keys, *between)


def _neighbours(total: Column, probabilities: Sequence[float], target) -> Column:
    edges = [edge(target(total, p)).cast("long") for p in probabilities for edge in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*edges))


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], names: Sequence[str], partition_by: Sequence[str] = (), refinements: int = 1
) -> DataFrame:
    """Exact quantiles of one column per group, one row per group with any value."""
    return quantiles(df, {name: (column, p) for name, p in zip(names, probs, strict=True)}, partition_by, refinements)
