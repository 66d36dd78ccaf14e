"""The integrity report: each check is a frame of (check_name, subject_code, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.functions import codes
from kinsieve.operators.joins import first_per_key, salted_join
from kinsieve.operators.ordered import asc
from kinsieve.operators.summaries import duplicated_keys


def _finding(df: DataFrame, name: str, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), "subject_code", detail.cast("string").alias("detail"))


def missing_in_log(specimens: DataFrame, log: DataFrame) -> DataFrame:
    """Patients with a specimen but no log entry: their first specimen."""
    patients = specimens.filter(F.col("subject_code").contains(codes.PATIENT))
    lost = salted_join(patients, log.select("subject_code"), ["subject_code"], "left_anti")
    first = first_per_key(lost.select("subject_code", "recd_date", "specimen_id"), ["subject_code"], [asc("specimen_id")])
    return _finding(first, "missing_in_log", F.col("recd_date"))


def duplicate_updates(updates: DataFrame) -> DataFrame:
    """Rows of subjects with more than one clinical update."""
    again = duplicated_keys(updates, ["subject_code"]).select("subject_code")
    return _finding(salted_join(updates, again, ["subject_code"], "left_semi"), "duplicate_update", F.col("update_date"))


def specimens_without_date(by_specimen: DataFrame) -> DataFrame:
    nothing = F.col("spec_date").isNull() & F.col("recd_date").isNull() & F.col("collect_date").isNull()
    return _finding(by_specimen.filter(nothing), "no_date", F.col("specimen_id"))


def study_code_mismatch(study: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """Well-formed codes under a foreign study, and malformed codes under one of our own."""
    well_formed = codes.is_well_formed(F.col("subject_code"))
    ours = F.col("study_code").isin(*own)
    foreign = _finding(study.filter(well_formed & ~ours), "code_in_foreign_study", F.col("study_code"))
    odd = _finding(study.filter(~well_formed & ours), "odd_code_in_study", F.col("study_code"))
    return foreign.unionByName(odd)


def parent_sex_contradiction(specimens: DataFrame) -> DataFrame:
    role = F.substring("subject_code", 9, 2)
    wrong = ((role == "FA") & (F.col("subj_sex") == "F")) | ((role == "MO") & (F.col("subj_sex") == "M"))
    return _finding(specimens.filter(wrong), "parent_sex", F.col("subj_sex"))


def born_after_collection(people: DataFrame) -> DataFrame:
    return _finding(people.filter(F.col("dob") > F.col("collect_date")), "born_after_collection", F.col("dob"))


def received_before_collected(people: DataFrame) -> DataFrame:
    early = people.filter(F.col("recd_date") < F.col("collect_date"))
    return _finding(early, "received_before_collected", F.datediff("recd_date", "collect_date"))


def missing_style(affected: DataFrame, support_group_site: str) -> DataFrame:
    """Surgeon's style missing although several surgeries are known; support-group sites excluded."""
    gap = F.col("surg_style").isNull() & (F.col("site_code") != support_group_site) & (F.col("surg_life") > 2)
    return _finding(affected.filter(gap), "missing_style", F.col("site_code"))


def missing_surgeries(affected: DataFrame) -> DataFrame:
    return _finding(affected.filter(F.col("surg_life").isNull()), "missing_surgeries", F.col("site_code"))


def too_many_specimens(by_specimen: DataFrame) -> DataFrame:
    """More than two specimens for anyone, more than one for a relative; counted in one pass."""
    counted = by_specimen.groupBy("subject_code").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("relationship") != codes.PATIENT, 1)).alias("n_relative")
    )
    anyone = _finding(counted.filter(F.col("n") > 2), "more_than_two", F.col("n"))
    relative = _finding(counted.filter(F.col("n_relative") > 1), "more_than_one_relative", F.col("n_relative"))
    return anyone.unionByName(relative)


def duplicate_stock(specimens: DataFrame) -> DataFrame:
    known = specimens.filter(F.col("stock_id").isNotNull())
    again = duplicated_keys(known, ["stock_id"]).select("stock_id")
    return _finding(salted_join(known, again, ["stock_id"], "left_semi"), "duplicate_stock", F.col("stock_id"))


def enrolment_gap(by_specimen: DataFrame) -> DataFrame:
    """Subjects whose specimens give different enrolment dates."""
    gaps = by_specimen.groupBy("subject_code").agg(
        F.datediff(F.max("enroll_date"), F.min("enroll_date")).alias("gap_days")
    )
    return _finding(gaps.filter(F.col("gap_days") > 0), "enrolment_gap", F.col("gap_days"))


def integrity_report(
    specimens: DataFrame,
    by_specimen: DataFrame,
    people: DataFrame,
    log: DataFrame,
    affected: DataFrame,
    updates: DataFrame,
    study: DataFrame,
    own_studies: tuple[str, ...],
    support_group_site: str,
) -> DataFrame:
    checks = [
        missing_in_log(specimens, log),
        duplicate_updates(updates),
        specimens_without_date(by_specimen),
        study_code_mismatch(study, own_studies),
        parent_sex_contradiction(specimens),
        born_after_collection(people),
        received_before_collected(people),
        missing_style(affected, support_group_site),
        missing_surgeries(affected),
        too_many_specimens(by_specimen),
        duplicate_stock(specimens),
        enrolment_gap(by_specimen),
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)
