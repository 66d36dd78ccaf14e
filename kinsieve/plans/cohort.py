"""From cleaned tables to the person view, the typing merge and the clinical summary of patients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kinsieve.functions import codes
from kinsieve.functions.dates import shift_years, years_between
from kinsieve.functions.numbers import bin_label, if_else, ratio, round_even, row_max, row_min
from kinsieve.functions.recoding import level_number
from kinsieve.operators.joins import first_per_key, inherit_from_relative, lookup_update, salted_join
from kinsieve.operators.ordered import asc, fill_missing
from kinsieve.operators.reshape import pivot_wide, union_fill, union_tagged
from kinsieve.operators.rules import Rule, apply_rules
from kinsieve.session import shared

# Typing levels, adult age, clinical thresholds.
TYPE_LEVELS = ("6", "11", "16", "611", "retest")
ADULT_AGE = 18.0
FREQUENT = 4
MANY_SURGERIES = 10
SHORT_FOLLOW_UP = 9 / 12
FOLLOW_UP_SLACK = -0.044


# -- typing ---------------------------------------------------------------------------------------


def stack_typing(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Union list of all typing, each row marked with its source and the source's priority."""
    parts = {}
    for number, (name, df) in enumerate(sources.items(), start=1):
        full = df if "stock_id" in df.columns else df.withColumn("stock_id", F.lit(None).cast("long"))
        parts[name] = full.select("subject_code", "stock_id", "type", F.lit(number).alias("priority"))
    return union_tagged(parts)


def typing_once(stacked: DataFrame) -> DataFrame:
    """One row per subject: the first source in priority wins, then the lowest stock id, then type."""
    order = [asc("priority"), asc("stock_id"), asc("type")]
    return first_per_key(stacked, ["subject_code"], order)


def typing_repeats(stacked: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Subjects typed more than once, one row per subject and stock, one column per source."""
    again = stacked.groupBy("subject_code").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = salted_join(stacked, again.select("subject_code"), ["subject_code"], "left_semi")
    return pivot_wide(rows, ["subject_code", "stock_id"], "source", sources, F.min("type"))


def add_typing(patients: DataFrame, once: DataFrame, target: str = "type") -> DataFrame:
    """Look the type up into the patients; anything outside the known levels becomes missing."""
    out = lookup_update(patients, once, ["subject_code"], {target: "type"}, hot=[])
    return out.withColumn(target, F.when(level_number(F.col(target), TYPE_LEVELS).isNotNull(), F.col(target)))


# -- specimen and person views --------------------------------------------------------------------


def specimen_view(log: DataFrame, specimens: DataFrame) -> DataFrame:
    """All specimens, those of patients with the log's demographics, with the earliest known date.

    `log` is unique by subject_code and has sex, race, ethnicity, dob, spec_date.
    """
    demographics = log.select("subject_code", "sex", "race", "ethnicity", "dob", "spec_date")
    joined = salted_join(specimens, demographics, ["subject_code"], "left")
    return joined.withColumns(
        {
            "family": codes.family_of(F.col("subject_code")),
            "relationship": codes.relationship_of(F.col("subject_code")),
            "enroll_date": row_min(F.col("spec_date"), F.col("collect_date"), F.col("recd_date"), F.col("keyed_date")),
        }
    )


def person_view(by_specimen: DataFrame, adult_families: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """One row per person from the specimen view: earliest specimen, best date of birth and sex, age
    class, race and ethnicity carried through the family."""
    kept = by_specimen.select(
        "subject_code", "family", "relationship", "sex", "race", "ethnicity", "dob", "spec_date",
        "collect_date", "recd_date", "enroll_date", "subj_sex", "subj_dob", "stock_id", "specimen_id",
    )
    order = [asc("enroll_date"), asc("stock_id"), asc("specimen_id")]
    # read again for hot families, sizes and cuts, so it is a shared stage
    people = shared(first_per_key(kept, ["subject_code"], order).drop("stock_id", "specimen_id"), "people")

    code = F.col("subject_code")
    suffix = codes.suffix_of(code)
    is_sibling = suffix.startswith("S")
    people = people.withColumn(
        "dob",
        F.coalesce("dob", "subj_dob", F.when(is_sibling, codes.sibling_birth_date(code))),
    )
    seen = row_min(F.col("spec_date"), F.col("recd_date"), F.col("collect_date"))
    people = people.withColumn("age", years_between(seen, F.col("dob"), 1))
    people = people.withColumn(
        "age_class", bin_label(F.col("age"), [float("-inf"), ADULT_AGE, float("inf")], ["child", "adult"])
    )
    rules = [Rule("age_class", suffix.isin(*codes.PARENTS, *codes.GRANDPARENTS), "adult")]
    if adult_families:
        rules.append(Rule("age_class", F.col("family").isin(*adult_families), "adult"))
    people = apply_rules(people, rules)
    people = inherit_from_relative(
        people, "family", ["age_class"], suffix == codes.PATIENT, is_sibling, [asc("subject_code")]
    )
    people = fill_missing(
        people, ["ethnicity", "race"], [asc("subject_code")], ["family"], both_ways=True, rows_per_bucket=rows_per_bucket
    )
    people = apply_rules(
        people,
        [
            Rule("sex", F.col("sex").isNull() & (F.col("subj_sex") == "F"), "Female"),
            Rule("sex", F.col("sex").isNull() & (F.col("subj_sex") == "M"), "Male"),
        ],
    )
    return people.select(
        "subject_code", "family", "relationship", "sex", "race", "ethnicity", "dob", "enroll_date", "age", "age_class"
    )


# -- clinical summary -----------------------------------------------------------------------------


def affected_view(log: DataFrame, updates: DataFrame) -> DataFrame:
    """All patients of the log with their clinical updates (several rows where several updates exist).

    The log is unique by subject, so subjects with very many updates are spread on the update side.
    """
    matched = salted_join(updates, log, ["subject_code"], "inner")
    updated = updates.select("subject_code").distinct()
    return union_fill(matched, log.join(updated, "subject_code", "left_anti"))


def severity(affected: DataFrame) -> DataFrame:
    """Last contact, worst-ever status, surgeries, follow-up, highest yearly frequency and composite.

    Needs spec_date, update_date, trach_log, trach_upd, site_pulmonary, site_bronchus, site_trachea,
    ever_distal, below_voice_box, surg_life, surg_life_upd, surg_12m, surg_12m_upd, surg_max_12m, dx_date.
    """
    c = F.col
    sites = row_max(c("site_pulmonary"), c("site_bronchus"), c("site_trachea"))
    involved = lambda x: if_else(x == 0, F.lit("cleardist"), F.lit("involvdist"))
    voice_box = c("below_voice_box")
    out = affected.withColumns(
        {
            "last_contact": row_max(c("update_date"), c("spec_date")),
            # the latest known status counts where no update exists
            "trach_upd": F.coalesce("trach_upd", "trach_log"),
            "surgeries": row_max(c("surg_life_upd"), c("surg_life")),
            "distal_log": involved(sites),
            "distal_upd": involved(c("ever_distal")),
            "below_voice_box": F.when(voice_box == "No", "cleardist")
            .when(voice_box.contains("Yes"), "involvdist")
            .when(~voice_box.isin("Not Recorded", "Unsure"), voice_box),
        }
    )
    either = lambda value, *names: reduce(lambda a, b: a | b, [c(n) == value for n in names])
    statuses, places = ("trach_log", "trach_upd"), ("distal_log", "distal_upd", "below_voice_box")
    had = either("Currently present", *statuses) | either("Used to have", *statuses)
    # the worse finding overrules the better one, whichever source it comes from
    out = out.withColumns(
        {
            "tracheostomy": F.when(had, "trached").when(either("Never", *statuses), "Never"),
            "distal": F.when(either("involvdist", *places), "involvdist").when(either("cleardist", *places), "cleardist"),
            "follow_up": years_between(c("last_contact"), c("dx_date"), 2),
        }
    )
    near_zero = (c("follow_up") < 0) & (c("follow_up") > FOLLOW_UP_SLACK)
    out = out.withColumn("follow_up", F.when(near_zero, 0.0).otherwise(c("follow_up")))
    yearly = round_even(ratio(c("surgeries"), c("follow_up")), 1)
    out = out.withColumn("annual_freq", F.when(c("follow_up") < SHORT_FOLLOW_UP, None).otherwise(yearly))
    highest = row_max(*[c(x).cast("double") for x in ("surg_12m", "surg_12m_upd", "surg_max_12m", "annual_freq")])
    out = out.withColumn("max_freq", round_even(highest))
    out = out.withColumn("max_freq", F.when(c("max_freq") < 1, 1.0).otherwise(c("max_freq")))
    return out.withColumn(
        "aggressive",
        (c("tracheostomy") == "trached")
        | (c("distal") == "involvdist")
        | (c("surgeries") >= MANY_SURGERIES)
        | (c("max_freq") >= FREQUENT),
    )


def with_enrolment(log: DataFrame, people: DataFrame) -> DataFrame:
    """The log with the enrolment date of the person view."""
    return log.join(people.select("subject_code", "enroll_date"), "subject_code", "left")


def life_durations(affected: DataFrame) -> DataFrame:
    """Ages at diagnosis and enrolment, age of the mother, time from her debut to the birth, onset.

    Needs dx_date, dob, enroll_date, mother_dob, mother_debut_age.
    """
    c = F.col
    out = affected.withColumns(
        {
            "debut_date": shift_years(c("mother_dob"), c("mother_debut_age") + F.lit(0.5)),
            "dx_age": years_between(c("dx_date"), c("dob")),
            "enroll_age": years_between(c("enroll_date"), c("dob")),
            "mother_age": years_between(c("dob"), c("mother_dob")),
        }
    )
    return out.withColumns(
        {
            "debut_to_birth": years_between(c("dob"), c("debut_date")),
            "onset": if_else(c("dx_age") >= ADULT_AGE, F.lit("adult"), F.lit("child")),
        }
    )
