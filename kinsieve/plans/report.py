"""Descriptive report of a sub-cohort, and contact lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kinsieve.functions.codes import family_of, relationship_of
from kinsieve.functions.numbers import ratio, round_even
from kinsieve.operators.reshape import string_agg, unpivot_groups
from kinsieve.operators.summaries import column_summary, counts_by, flag_totals, level_summary, shares_at_or_below
from kinsieve.plans.cohort import FREQUENT, MANY_SURGERIES

# Ages at which the distributions are reported.
REPORT_AGES = (3, 5, 10, 15, 18, 20, 25, 30, 50)
FLAGS = ("trach_flag", "distal_flag", "surgery_flag", "frequency_flag", "aggressive")
MEASURES = ("dx_age", "enroll_age", "surgeries", "max_freq")
SUMMARY = ("min", "q1", "median", "mean", "q3", "max")


def without_prefixes(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop families named by code prefix; with no match nothing is dropped."""
    return df.filter(~F.col("subject_code").rlike("^(" + "|".join(prefixes) + ")"))


def family_composition(people: DataFrame) -> DataFrame:
    """How many families have which set of relationships, with the share of all families."""
    members = people.select(
        family_of(F.col("subject_code")).alias("family"), relationship_of(F.col("subject_code")).alias("relationship")
    )
    sets = string_agg(members, ["family"], "relationship", "relationships")
    families = members.agg(F.count_distinct("family")).scalar()
    return counts_by(sets, "relationships").withColumn("share", round_even(ratio(F.col("n"), families), 2))


def cohort_report(affected: DataFrame, people: DataFrame) -> DataFrame:
    """Long report: (section, item, n, share, value) over patients and people of the sub-cohort."""

    def sections(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Counts and shares of the levels of several columns in one pass."""
        counted = level_summary(df, columns).toDF("section", "item", "n")
        whole = df.agg(F.count("*")).scalar()
        return counted.withColumn("share", round_even(ratio(F.col("n"), whole), 2))

    flagged = affected.withColumns(
        {
            "trach_flag": F.col("tracheostomy") == "trached",
            "distal_flag": F.col("distal") == "involvdist",
            "surgery_flag": F.col("surgeries") >= MANY_SURGERIES,
            "frequency_flag": F.col("max_freq") >= FREQUENT,
        }
    )
    totals = flag_totals(flagged, FLAGS)
    flags = totals.unpivot(["measure"], list(FLAGS), "item", "x").groupBy("item").agg(
        F.max(F.when(F.col("measure") == "count", F.col("x"))).cast("long").alias("n"),
        F.max(F.when(F.col("measure") == "share", F.col("x"))).alias("share"),
    )
    measured = column_summary(affected, MEASURES).unpivot(["column_name", "missing"], list(SUMMARY), "statistic", "x")
    rows = affected.agg(F.count("*")).scalar()

    parts = [
        sections(affected, ["sex", "race", "ethnicity", "onset", "tracheostomy", "distal"]),
        sections(people, ["relationship"]),
        family_composition(people).select(
            F.lit("families").alias("section"), F.col("relationships").alias("item"), "n", "share"
        ),
        shares_at_or_below(affected, {"dx": "dx_age"}, REPORT_AGES).select(
            F.lit("dx_age_at_or_below").alias("section"),
            F.col("point").cast("int").cast("string").alias("item"),
            F.lit(None).cast("long").alias("n"),
            F.col("dx").alias("share"),
        ),
    ]
    plain = reduce(lambda a, b: a.unionByName(b), parts).withColumn("value", F.lit(None).cast("double"))
    flags = flags.select(F.lit("flags").alias("section"), "item", "n", "share", F.lit(None).cast("double").alias("value"))
    measured = measured.select(
        F.lit("summary").alias("section"),
        F.concat_ws(" ", "column_name", "statistic").alias("item"),
        (rows - F.col("missing")).alias("n"),
        F.lit(None).cast("double").alias("share"),
        round_even(F.col("x"), 3).alias("value"),
    )
    return plain.unionByName(flags).unionByName(measured)


def site_contacts(sites: DataFrame, mails: DataFrame, names: Sequence[str]) -> DataFrame:
    """Approved sites (those with an approval) with the addresses of the person in charge, found by name."""
    return sites.filter(F.col("approval").isNotNull()).join(mails, list(names), "left")


def contact_list(contacts: DataFrame, ids: Sequence[str], kinds: Sequence[str], mails: Sequence[str]) -> DataFrame:
    """Addresses in use per person: parallel columns to rows, old and empty ones dropped, joined up."""
    long = unpivot_groups(contacts, ids, {"kind": kinds, "mail": mails})
    old = F.coalesce(F.col("kind").rlike("(?i)old"), F.lit(False))
    return string_agg(long.filter(F.col("mail").isNotNull() & ~old), ids, "mail", "mails", ",")
