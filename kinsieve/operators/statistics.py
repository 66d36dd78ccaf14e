"""Regressions and tests: one distributed aggregate of moments, then arithmetic on its few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.functions.numbers import ratio
from kinsieve.functions.tails import f_p_value, range_p_value, t_p_value

# what the normal-equation solver of Spark's machine learning library takes
SOLVER_COLUMNS = 4_096


def simple_regression(df: DataFrame, y: Column, x: Column, p_values: bool = False) -> DataFrame:
    """Intercept, slope, their standard errors and t values, R squared, from one pass."""
    x, y = x.cast("double"), y.cast("double")
    m = df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_avgx(y, x).alias("mean_x"),
    )
    spread = ratio((1 - F.col("r_squared")) * F.col("syy"), F.col("n") - 2)
    m = m.withColumn("sigma", F.sqrt(spread))
    m = m.withColumn("se_slope", F.col("sigma") / F.sqrt("sxx"))
    m = m.withColumn(
        "se_intercept", F.col("sigma") * F.sqrt(1 / F.col("n") + F.col("mean_x") * F.col("mean_x") / F.col("sxx"))
    )
    m = m.withColumn("t_slope", ratio(F.col("slope"), F.col("se_slope")))
    m = m.withColumn("t_intercept", ratio(F.col("intercept"), F.col("se_intercept")))
    out = ["n", "intercept", "slope", "se_intercept", "se_slope", "t_intercept", "t_slope", "r_squared", "sigma"]
    if p_values:
        m = m.withColumn("p_slope", t_p_value(F.col("t_slope"), (F.col("n") - 2).cast("double")))
        out.append("p_slope")
    return m.select(*out)


def model_regression(
    df: DataFrame, y: str, terms: Sequence[str], interactions: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Least squares on numeric and text columns with pairwise interactions, one row per coefficient.

    A text column enters as one indicator per level but the first; an interaction as the products of
    both sides' columns. Rows with a missing value are left out. The normal-equation solver makes one
    pass and gathers a matrix of the size of the model, which has at most SOLVER_COLUMNS columns.
    """
    known = df.select(y, *terms).dropna()
    parts: dict[str, dict[str, Column]] = {}
    for term in terms:
        if dict(known.dtypes)[term] == "string":
            levels = sorted(r[0] for r in known.select(term).distinct().limit(SOLVER_COLUMNS + 2).collect())
            parts[term] = {f"{term}[{v}]": (F.col(term) == F.lit(v)).cast("double") for v in levels[1:]}
        else:
            parts[term] = {term: F.col(term).cast("double")}
    design = {name: c for part in parts.values() for name, c in part.items()}
    for a, b in interactions:
        design.update({f"{na}:{nb}": ca * cb for na, ca in parts[a].items() for nb, cb in parts[b].items()})
    names = list(design)
    if len(names) > SOLVER_COLUMNS:
        raise ValueError(f"the model has more than the {SOLVER_COLUMNS} columns that the solver takes")
    numbered = known.select(
        F.col(y).cast("double").alias("__y"), *[c.alias(f"__x{i}") for i, c in enumerate(design.values())]
    )
    assembler = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(names))], outputCol="__x")
    model = LinearRegression(featuresCol="__x", labelCol="__y", solver="normal").fit(assembler.transform(numbered))
    s = model.summary
    values = zip(
        [*names, "(Intercept)"],
        [*model.coefficients, model.intercept],
        s.coefficientStandardErrors,
        s.tValues,
        s.pValues,
    )
    rows = [(t, float(c), float(e), float(v), float(p)) for t, c, e, v, p in values]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, t double, p double")


def welch_test(df: DataFrame, y: Column, split: Column, p_values: bool = False) -> DataFrame:
    """Two-sample t test with unequal variances; `split` is a boolean, other rows are left out."""
    known = df.select(y.cast("double").alias("y"), split.alias("s"))
    aggs = []
    for side, cond in (("false", ~F.col("s")), ("true", F.col("s"))):
        v = F.when(cond, F.col("y"))
        aggs += [
            F.count(v).alias(f"n_{side}"),
            F.avg(v).alias(f"mean_{side}"),
            (F.var_samp(v) / F.count(v)).alias(f"__v_{side}"),
        ]
    m = known.agg(*aggs)
    v0, v1 = F.col("__v_false"), F.col("__v_true")
    m = m.withColumn("t", ratio(F.col("mean_false") - F.col("mean_true"), F.sqrt(v0 + v1)))
    m = m.withColumn(
        "df", ratio((v0 + v1) * (v0 + v1), v0 * v0 / (F.col("n_false") - 1) + v1 * v1 / (F.col("n_true") - 1))
    )
    out = ["n_false", "n_true", "mean_false", "mean_true", "t", "df"]
    if p_values:
        m = m.withColumn("p", t_p_value(F.col("t"), F.col("df")))
        out.append("p")
    return m.select(*out)


def _moments(df: DataFrame, y: Column, group: Column) -> DataFrame:
    known = df.select(y.cast("double").alias("y"), group.alias("level")).filter(
        F.col("y").isNotNull() & F.col("level").isNotNull()
    )
    return known.groupBy("level").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("within")
    )


def one_way_anova(df: DataFrame, y: Column, group: Column, p_values: bool = False) -> DataFrame:
    """Analysis of variance over the levels of `group`."""
    m = _moments(df, y, group).agg(
        F.count("*").alias("levels"),
        F.sum("n").alias("n"),
        F.sum("within").alias("ss_within"),
        (
            F.sum(F.col("n") * F.col("mean") * F.col("mean"))
            - F.sum(F.col("n") * F.col("mean")) * F.sum(F.col("n") * F.col("mean")) / F.sum("n")
        ).alias("ss_between"),
    )
    m = m.withColumns({"df_between": F.col("levels") - 1, "df_within": F.col("n") - F.col("levels")})
    m = m.withColumn(
        "f",
        ratio(
            ratio(F.col("ss_between"), F.col("df_between")), ratio(F.col("ss_within"), F.col("df_within"))
        ),
    )
    out = ["df_between", "df_within", "ss_between", "ss_within", "f"]
    if p_values:
        m = m.withColumn(
            "p", f_p_value(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
        )
        out.append("p")
    return m.select(*out)


def honest_differences(df: DataFrame, y: Column, group: Column, p_values: bool = False) -> DataFrame:
    """Pairwise differences of level means with the studentised range statistic.

    The levels come from a fixed list of bins or categories; only their moments are paired.
    """
    one = _moments(df, y, group).agg(
        F.sort_array(F.collect_list(F.struct("level", "n", "mean"))).alias("levels"),
        F.count("*").alias("k"),
        (F.sum("n") - F.count("*")).alias("df"),
        ratio(F.sum("within"), F.sum("n") - F.count("*")).alias("mse"),
    )
    first = one.select("*", F.posexplode("levels").alias("i", "a"))
    pairs = first.select("*", F.explode(F.slice("levels", F.col("i") + 2, F.col("k").cast("int"))).alias("b"))
    difference = F.col("b.mean") - F.col("a.mean")
    error = F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    out = pairs.select(
        F.col("a.level").alias("level_a"),
        F.col("b.level").alias("level_b"),
        difference.alias("difference"),
        ratio(F.abs(difference), error).alias("q"),
        "df",
        "k",
    )
    if p_values:
        out = out.withColumn("p", range_p_value(F.col("q"), F.col("k").cast("double"), F.col("df").cast("double")))
    return out.drop("k")
