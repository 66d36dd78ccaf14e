"""Seeded sampling: the same seed and rows give the same draw on any cluster layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.functions.numbers import uniform
from kinsieve.operators.quantiles import at_positions

# so many rows are taken by a top-n that ends in one task; more are cut off at the value of the n-th
MOST_AT_ONCE = 100_000


def first_n(df: DataFrame, n: int, order: str, key: Sequence[str]) -> DataFrame:
    """The n rows of smallest `order` (a number), ties by key; all rows when n is larger.

    A large n never meets in one task: the n-th value is found by selection, rows below it are kept where they
    are, and only the rows that share the value itself are sorted by key. The value comes to the driver, so this
    runs a job.
    """
    if n <= MOST_AT_ONCE:
        return df.orderBy(order, *key).limit(n)
    last = at_positions(df, order, lambda total: F.array(F.least(F.lit(n), total) - 1)).first()
    if last is None:
        return df
    value = F.lit(last["value"])
    ties = df.filter(F.col(order) == value).orderBy(*key).limit(n - last["below"])
    return df.filter(F.col(order) < value).unionByName(ties)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """Simple random sample of n rows without replacement (all rows when n is larger)."""
    u = uniform(seed, *[F.col(k) for k in key])
    return first_n(df.withColumn("__u", u), n, "__u", key).drop("__u")


def weighted_sample_n(
    df: DataFrame, n: int, weight: Column, key: Sequence[str], seed: int, log_weight: bool = False
) -> DataFrame:
    """Weighted sample of n rows without replacement.

    Ordering by -ln(u)/w and keeping the n smallest has the same law as n successive draws with
    probability proportional to the remaining weights, and needs only a top-n instead of a loop. Rows
    with a missing, zero or negative weight are never drawn. `log_weight` says that `weight` is the
    logarithm of the weight, for products too large for a double.
    """
    exponential = -F.log(uniform(seed, *[F.col(k) for k in key]))
    weighted = df.withColumn("__w", weight.cast("double"))
    if log_weight:
        keyed = weighted.filter(F.col("__w").isNotNull()).withColumn("__e", F.log(exponential) - F.col("__w"))
    else:
        keyed = weighted.filter(F.col("__w") > 0).withColumn("__e", exponential / F.col("__w"))
    return first_n(keyed, n, "__e", key).drop("__w", "__e")


def random_integer(high: int, seed: int, *key: Column) -> Column:
    """Uniform integer in 1..high fixed by the key; different keys are independent draws."""
    return (F.lit(1) + F.floor(uniform(seed, *key) * high)).cast("int")
