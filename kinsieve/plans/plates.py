"""Plate layouts, dilution and pipetting volumes, assay quality comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kinsieve.functions import codes
from kinsieve.functions.numbers import null_count, ratio, round_even, signif
from kinsieve.operators.joins import salted_join, with_average_rank
from kinsieve.operators.ordered import asc, with_index
from kinsieve.operators.rules import Rule, apply_rules
from kinsieve.operators.sampling import random_integer
from kinsieve.operators.summaries import group_stats
from kinsieve.session import shared

# Samples per plate, dilution target, pipetting limits, copies per nanogram.
SAMPLES_PER_PLATE = codes.PLATE_WELLS - 1
DILUTION_TARGET = 20
LEAST_STOCK_UL = 5.0
LEAST_TOTAL_UL = 20.0
COPIES_PER_NG = 320


def plate_layout(stocks: DataFrame, seed: int, rows_per_bucket: int | None = None) -> DataFrame:
    """Fill plates in order of concentration, 95 samples each, with one random blank well per plate.

    Samples at or behind the blank move one well on. The blank is emitted next to its plate's first
    sample, so no plate is gathered anywhere.
    """
    order = [asc("conc", nulls_first=False), asc("stock_id"), asc("specimen_id")]
    placed = with_index(shared(stocks, "to-plate"), order, name="__i", rows_per_bucket=rows_per_bucket)
    zero = F.col("__i") - 1
    placed = placed.withColumns(
        {
            "plate": (F.floor(zero / SAMPLES_PER_PLATE) + 1).cast("long"),
            "__slot": (F.pmod(zero, F.lit(SAMPLES_PER_PLATE)) + 1).cast("int"),
        }
    )
    placed = placed.withColumn("__blank", random_integer(codes.PLATE_WELLS, seed, F.col("plate")))
    position = F.col("__slot") + F.when(F.col("__slot") >= F.col("__blank"), 1).otherwise(0)
    sample = F.struct(position.alias("position"), F.lit(False).alias("is_blank"))
    blank = F.struct(F.col("__blank").alias("position"), F.lit(True).alias("is_blank"))
    wells = F.when(F.col("__slot") == 1, F.array(sample, blank)).otherwise(F.array(sample))
    out = placed.select("*", F.inline(wells))
    kept = [c for c in stocks.columns if c not in ("stock_id", "specimen_id", "conc")]
    missing = {c: F.when(~F.col("is_blank"), F.col(c)) for c in ["specimen_id", *kept]}
    out = out.withColumns(missing).withColumns(
        {
            "stock_id": F.when(F.col("is_blank"), F.lit(0)).otherwise(F.col("stock_id")),
            "conc": F.when(~F.col("is_blank"), round_even(F.col("conc"))),
            "well": codes.well_label(F.col("position")),
        }
    )
    return out.select("plate", "well", "position", "stock_id", "specimen_id", "conc", *kept)


def plate_stats(layout: DataFrame) -> DataFrame:
    """Lowest, median and highest (already rounded) concentration per plate."""
    # a plate has at most 96 wells by construction, so the built-in median is safe
    return layout.groupBy("plate").agg(
        F.min("conc").alias("min_conc"), F.median("conc").alias("median_conc"), F.max("conc").alias("max_conc")
    )


def dilution_volumes(stats: DataFrame) -> DataFrame:
    """Volumes of stock and water that bring a plate's median to the target."""
    out = apply_rules(
        stats,
        [
            Rule("dna_to_add", F.col("median_conc") <= DILUTION_TARGET, 6),
            Rule("dna_to_add", F.col("median_conc") > DILUTION_TARGET, 5),
        ],
    )
    water = round_even(F.col("median_conc") * F.col("dna_to_add") / DILUTION_TARGET - F.col("dna_to_add"))
    return out.withColumn("water_to_add", F.when(water < 0, F.lit(0.0)).otherwise(water))


def dilution_plan(layout: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per well totals after dilution; every well of a plate shares the plate's volumes."""
    out = layout.join(volumes.select("plate", "dna_to_add", "water_to_add"), "plate")
    out = out.withColumns(
        {
            "total_ng": F.col("conc") * F.col("dna_to_add"),
            "total_ul": F.col("dna_to_add") + F.col("water_to_add"),
        }
    )
    return out.withColumn("diluted_conc", ratio(F.col("total_ng"), F.col("total_ul")))


def pipette_plan(stocks: DataFrame) -> DataFrame:
    """Stock and diluent volumes: 1000 ng below 50 ng/ul, 750 ng otherwise, with least volumes."""
    c = F.col
    weak, strong = c("conc") < 50, c("conc") >= 50
    diluted_to = lambda target: signif(c("pip_stock") * c("conc") / F.lit(target) - c("pip_stock"), 2)
    return apply_rules(
        stocks,
        [
            Rule("pip_stock", weak, signif(ratio(F.lit(1000.0), c("conc")), 2)),
            Rule("pip_stock", strong, signif(ratio(F.lit(750.0), c("conc")), 2)),
            Rule("pip_stock", c("pip_stock") < LEAST_STOCK_UL, LEAST_STOCK_UL),
            Rule("pip_diluent", weak, 0.0),
            Rule("pip_diluent", strong, diluted_to(75.0)),
            Rule("pip_diluent", c("pip_stock") + c("pip_diluent") < LEAST_TOTAL_UL, diluted_to(50.0)),
        ],
    )


def qc_join(report: DataFrame, sent: DataFrame, calls: Sequence[str]) -> DataFrame:
    """Match assay report and shipping list by position; estimated concentration, both ranks, their
    difference, missing calls."""
    both = report.join(sent, "position")
    both = both.withColumns(
        {
            "qc_conc": F.col("copies") / COPIES_PER_NG / 2,
            "missing_calls": null_count(*[F.col(c) for c in calls]),
        }
    )
    both = shared(both, "qc")
    both = with_average_rank(both, "conc", "rank_sent")
    both = with_average_rank(both, "copies", "rank_qc")
    return both.withColumn("rank_diff", F.col("rank_sent") - F.col("rank_qc"))


def qc_summary(compared: DataFrame) -> DataFrame:
    """Passed or not, by tissue: counts, extremes and percentiles of both concentrations."""
    return group_stats(
        compared,
        ["passed", "tissue"],
        {
            "n": F.count("*"),
            "min_sent": F.min("conc"),
            "min_qc": F.min("qc_conc"),
            "max_qc": F.max("qc_conc"),
        },
        {
            "p10_sent": ("conc", 0.1),
            "p10_qc": ("qc_conc", 0.1),
            "p50_qc": ("qc_conc", 0.5),
        },
    )
