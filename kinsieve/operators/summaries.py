"""Counts, shares, summaries and the data behind plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.functions.numbers import ratio, round_even
from kinsieve.functions.tails import t_quantile
from kinsieve.operators.joins import salted_join
from kinsieve.operators.ordered import with_running_sum
from kinsieve.operators.quantiles import exact_quantiles, quantiles as quantiles_of


def counts_by(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def shares_by(df: DataFrame, *keys: str, digits: int = 2, total: DataFrame | None = None) -> DataFrame:
    """Counts with their share of all rows, or of the rows of `total` when that is another frame.

    The total is a one-row aggregate read as a scalar, not a window over the groups.
    """
    whole = (df if total is None else total).agg(F.count("*")).scalar()
    return counts_by(df, *keys).withColumn("share", round_even(ratio(F.col("n"), whole), digits))


def cumulative_shares(
    df: DataFrame, key: str, order_by, total: DataFrame | None = None, digits: int = 3, rows_per_bucket=None
) -> DataFrame:
    """Counts per key with the running share; the denominator may come from an unfiltered frame."""
    whole = (df if total is None else total).agg(F.count("*")).scalar()
    running = with_running_sum(counts_by(df, key), "n", order_by, name="__upto", rows_per_bucket=rows_per_bucket)
    return running.select(key, "n", round_even(ratio(F.col("__upto"), whole), digits).alias("cumulative"))


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, Column],
    quantiles: Mapping[str, tuple[str, float]] | None = None,
    refinements: int = 1,
) -> DataFrame:
    """Named aggregates per group plus exact quantiles given as {name: (column, probability)}."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    if quantiles:
        # both sides hold one row per group, so no key can be hot
        out = salted_join(out, quantiles_of(df, quantiles, keys, refinements), keys, "left", hot=[], null_safe=True)
    return out


def column_summary(df: DataFrame, columns: Sequence[str], refinements: int = 1) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values of each numeric column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    return group_stats(
        long,
        ["column_name"],
        {
            "min": F.min("value"),
            "mean": F.avg("value"),
            "max": F.max("value"),
            "missing": F.count("*") - F.count("value"),
        },
        {"q1": ("value", 0.25), "median": ("value", 0.5), "q3": ("value", 0.75)},
        refinements,
    )


def level_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each level of each categorical column, missing values as their own level."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "level"
    )
    return counts_by(long, "column_name", "level")


def shares_at_or_below(df: DataFrame, columns: Mapping[str, str], points: Sequence[float], digits: int = 2) -> DataFrame:
    """Empirical distribution of several columns at given points, one row per point, in a single pass.

    `columns` maps output names to columns.
    """
    aggs = [F.count(c).alias(f"__n_{name}") for name, c in columns.items()]
    for i, point in enumerate(points):
        for name, c in columns.items():
            aggs.append(F.count(F.when(F.col(c) <= F.lit(float(point)), 1)).alias(f"__{i}_{name}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(float(point)).alias("point"),
            *[
                round_even(ratio(F.col(f"__{i}_{name}"), F.col(f"__n_{name}")), digits).alias(name)
                for name in columns
            ],
        )
        for i, point in enumerate(points)
    ]
    return one.select(F.inline(F.array(*rows)))


def histogram_by_width(
    df: DataFrame,
    column: str,
    width: float,
    facet: Sequence[str] = (),
    origin: float = 0.0,
    density: bool = False,
) -> DataFrame:
    """Counts in left-closed bins of one width; `density` divides by rows of the facet times width."""
    bin_start = F.floor((F.col(column) - origin) / width) * width + origin
    counted = (
        df.filter(F.col(column).isNotNull()).groupBy(*facet, bin_start.alias("bin_start")).agg(F.count("*").alias("n"))
    )
    if not density:
        return counted
    if facet:
        sizes = df.filter(F.col(column).isNotNull()).groupBy(*facet).agg(F.count("*").alias("__size"))
        counted = salted_join(counted, sizes, facet, "left", null_safe=True)
    else:
        counted = counted.withColumn("__size", df.agg(F.count(column)).scalar())
    return counted.withColumn("density", F.col("n") / (F.col("__size") * F.lit(width))).drop("__size")


def histogram_by_count(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in `bins` equal right-closed bins between minimum and maximum (the minimum joins bin 1)."""
    ends = df.agg(F.struct(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).alias("e"))
    placed = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), ends.scalar().alias("e"))
    share = ratio((F.col("x") - F.col("e.low")) * bins, F.col("e.high") - F.col("e.low"))
    number = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.coalesce(share, F.lit(1.0))).cast("int")))
    return placed.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, column: str, keys: Sequence[str], refinements: int = 1) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and outliers per group."""
    boxes = exact_quantiles(df, column, [0.25, 0.5, 0.75], ["q1", "median", "q3"], keys, refinements)
    rows = salted_join(df.filter(F.col(column).isNotNull()).select(*keys, column), boxes, keys, "inner", null_safe=True)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def group_means(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")
    ).withColumn("se", F.col("sd") / F.sqrt("n"))


def group_means_interval(df: DataFrame, column: str, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Group means with a t interval."""
    half = t_quantile(level, F.col("n") - 1) * F.col("se")
    return group_means(df, column, keys).withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def flag_totals(df: DataFrame, flags: Sequence[str], digits: int = 2) -> DataFrame:
    """Two rows: share and number of rows in which each flag holds (a missing flag does not)."""
    one = df.agg(F.count("*").alias("__n"), *[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])
    total = F.struct(F.lit("count").alias("measure"), *[F.col(f).cast("double").alias(f) for f in flags])
    share = F.struct(
        F.lit("share").alias("measure"), *[round_even(ratio(F.col(f), F.col("__n")), digits).alias(f) for f in flags]
    )
    return one.select(F.inline(F.array(share, total)))


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count of every named table."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """How often two columns agree, disagree, or cannot be compared."""
    return counts_by(df, (F.col(left) == F.col(right)).alias("same"))


def duplicated_keys(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Keys that occur more than once."""
    return counts_by(df, *keys, name=name).filter(F.col(name) > 1)


def rows_of(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Detail rows of the given keys. The keys that repeat most are the likely violators, so the join
    is salted."""
    return salted_join(df, keys, on, how)


def z_score(df: DataFrame, column: str, name: str) -> DataFrame:
    """Standardise with the sample standard deviation; the two moments are read as one scalar."""
    moments = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).alias("moments")).scalar()
    with_moments = df.withColumn("__moments", moments)
    z = ratio(F.col(column) - F.col("__moments.m"), F.col("__moments.s"))
    return with_moments.withColumn(name, z).drop("__moments")
