"""Numeric expressions with the rounding, sampling and NULL rules the cohort work relies on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def round_even(x: Column, digits: int = 0) -> Column:
    """Round to `digits` decimals, exact halves to the even neighbour."""
    if digits == 0:
        return F.rint(x)
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale


def signif(x: Column, digits: int) -> Column:
    """Keep `digits` significant digits; zero stays zero, NULL stays NULL."""
    x = x.cast("double")
    shift = (F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))).cast("double")
    fine = F.rint(x * F.pow(F.lit(10.0), shift)) / F.pow(F.lit(10.0), shift)
    coarse = F.rint(x / F.pow(F.lit(10.0), -shift)) * F.pow(F.lit(10.0), -shift)
    return F.when(x == 0, F.lit(0.0)).when(shift >= 0, fine).otherwise(coarse)


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) fixed by the seed and the row key: 52 bits of an md5, never 0 or 1.

    A keyed hash rather than `rand()`, so a recomputed task draws the same numbers.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in key])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice in which a NULL condition gives NULL."""
    return F.when(cond, yes).when(~cond, no)


def row_max(*cols: Column, skip_nulls: bool = True) -> Column:
    """Row-wise maximum; without `skip_nulls` a single NULL makes the result NULL."""
    return _row_extreme(F.greatest, cols, skip_nulls)


def row_min(*cols: Column, skip_nulls: bool = True) -> Column:
    """Row-wise minimum; without `skip_nulls` a single NULL makes the result NULL."""
    return _row_extreme(F.least, cols, skip_nulls)


def _row_extreme(pick, cols, skip_nulls: bool) -> Column:
    value = cols[0] if len(cols) == 1 else pick(*cols)
    if skip_nulls:
        return value
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), value)


def null_count(*cols: Column) -> Column:
    """How many of the columns are NULL in this row."""
    return reduce(lambda a, b: a + b, [F.isnull(c).cast("int") for c in cols])


def bin_label(x: Column, breaks: list[float], labels: list[str], closed: str = "right") -> Column:
    """Label of the interval that holds `x`; `breaks` has one more entry than `labels`.

    A value outside every interval, or NULL, gives NULL. Infinite ends are open.
    """
    if len(breaks) != len(labels) + 1:
        raise ValueError("need one more break than labels")
    out: Column | None = None
    for low, high, label in zip(breaks, breaks[1:], labels):
        if closed == "right":
            inside = (x > F.lit(float(low))) & (x <= F.lit(float(high)))
        elif closed == "left":
            inside = (x >= F.lit(float(low))) & (x < F.lit(float(high)))
        else:
            raise ValueError("closed must be 'right' or 'left'")
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def guarded_product(x: Column) -> Column:
    """Aggregate product that is NULL as soon as one input is NULL."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.product(x))


def mixing_shares(tenths: Column) -> tuple[Column, Column]:
    """Share of the first component and its complement, from a number of tenths."""
    first = tenths / F.lit(10.0)
    return first, F.lit(1.0) - first


def within(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp; a NULL stays NULL."""
    if low is not None:
        x = F.when(x < low, F.lit(low)).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(high)).otherwise(x)
    return x
