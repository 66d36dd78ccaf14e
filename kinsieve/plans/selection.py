"""Scores and draws: which specimens, families and markers to take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kinsieve.functions import codes
from kinsieve.functions.numbers import ratio, signif
from kinsieve.functions.recoding import recode
from kinsieve.operators.joins import salted_join, with_level_rank
from kinsieve.operators.quantiles import exact_quantiles
from kinsieve.operators.reshape import string_agg, union_distinct, union_fill
from kinsieve.operators.sampling import weighted_sample_n
from kinsieve.operators.summaries import z_score
from kinsieve.plans.plates import pipette_plan
from kinsieve.session import shared

# Absorbance ratio target, tissue scores, trio labels, levels in their order.
GOOD_RATIO = 1.8
NO_YIELD_RANK = 0.0001
TISSUE_SCORES = {"WB": 10, "MW": 4, "BUC": 3, "LRNXP": 5}
TRIO_LABELS = {1: "solo", 2: "duo", 3: "trio"}
TRACHEOSTOMY = ("Never", "trached")
DISTAL = ("cleardist", "involvdist")


def impute_low(df: DataFrame, column: str, p: float = 0.1, digits: int = 2) -> DataFrame:
    """A missing score takes the p-quantile of the known ones, cut to significant digits.

    The scores are read more than once and stand on many joins and ranks, so they are a shared stage.
    """
    df = shared(df, "scores")
    low = exact_quantiles(df, column, [p], ["q"]).select(signif(F.col("q"), digits).alias("q")).scalar()
    return df.withColumn("__low", low).withColumn(column, F.coalesce(column, "__low")).drop("__low")


def expression_score(affected: DataFrame) -> DataFrame:
    """How strongly the condition shows: frequencies and ranks over the age at diagnosis.

    An age of zero gives no finite score and is imputed like a missing one.
    """
    affected = shared(affected, "affected")
    ranked = with_level_rank(affected, "tracheostomy", "rank_trach", TRACHEOSTOMY)
    ranked = with_level_rank(ranked, "distal", "rank_distal", DISTAL)
    c = F.col
    strength = c("max_freq") * (1 + c("annual_freq")) * (1 + c("surgeries")) * c("rank_trach") * c("rank_distal")
    return impute_low(ranked.withColumn("express", ratio(strength, c("dx_age"))), "express")


def stock_measures(stock: DataFrame) -> DataFrame:
    """Yield in micrograms and the shortfall of the absorbance ratio."""
    low = F.when(F.col("abs_ratio") > GOOD_RATIO, F.lit(0.0)).when(
        F.col("abs_ratio") <= GOOD_RATIO, GOOD_RATIO - F.col("abs_ratio")
    )
    return stock.withColumns({"ratio_low": low, "yield_ug": F.col("conc") * F.col("volume") * 0.001})


def quality_score(measured: DataFrame) -> DataFrame:
    """Stock quality for blood and mouthwash, weighted by the squared rank of the tissue.

    Blood is judged by how far its log yield falls short of the average, mouthwash by its yield. The moments, the ranks and the
    scores each read the measures, which stand on a join: they are a shared stage.
    """
    measured = shared(measured, "measured")
    blood = measured.filter(F.col("tissue") == "WB")
    blood = z_score(blood.withColumn("__log", F.ln(F.when(F.col("yield_ug") > 0, F.col("yield_ug")))), "__log", "__z")
    shortfall = F.when(-F.col("__z") < 1, F.lit(1.0)).otherwise(-F.col("__z"))
    blood = blood.withColumn("quality", ratio(F.lit(1.0), shortfall * (F.col("ratio_low") + 0.1))).drop("__log", "__z")
    wash = measured.filter(F.col("tissue") == "MW")
    wash_quality = F.when(F.col("yield_ug") <= 0, F.lit(NO_YIELD_RANK)).otherwise(
        ratio(F.col("yield_ug"), F.col("ratio_low") + 0.1)
    )
    both = union_fill(blood, wash.withColumn("quality", wash_quality))
    ranked = with_level_rank(both, "tissue", "rank_tissue", ("MW", "WB"))
    return ranked.withColumn("quality", F.col("quality") * F.pow("rank_tissue", F.lit(2.0))).drop("rank_tissue")


def trio_status(by_specimen: DataFrame) -> DataFrame:
    """Per family: father present, mother present, and solo, duo or trio."""
    flags = by_specimen.groupBy("family").agg(
        F.bool_or(F.col("relationship") == "FA").alias("father"),
        F.bool_or(F.col("relationship") == "MO").alias("mother"),
    )
    known = 1 + F.coalesce("father", F.lit(False)).cast("int") + F.coalesce("mother", F.lit(False)).cast("int")
    return flags.withColumn("trio_number", known).withColumn("trio", recode(F.col("trio_number"), TRIO_LABELS))


def selection_score(
    express: DataFrame, quality: DataFrame, trios: DataFrame, on_chip: DataFrame
) -> DataFrame:
    """One row per stock of a patient: quality squared times expression, trio and typing over chip rank.

    `on_chip` holds the stock_ids that already have chip data.
    """
    patients = quality.filter(F.col("relationship") == codes.PATIENT).drop("relationship")
    wanted = express.select(
        "subject_code", "dx_age", "max_freq", "annual_freq", "surgeries", "distal", "tracheostomy", "type", "express"
    )
    scored = salted_join(patients, wanted, ["subject_code"], "inner")
    done = on_chip.select("stock_id").distinct().withColumn("__chip", F.lit(True))
    scored = salted_join(scored, done, ["stock_id"], "left", hot=[])
    scored = scored.withColumn("chip", F.when(F.col("__chip"), "haveillumina").otherwise("noillumina")).drop("__chip")
    scored = with_level_rank(scored, "chip", "rank_chip", ("haveillumina", "noillumina"))
    scored = scored.withColumn("family", codes.family_of(F.col("subject_code")))
    scored = salted_join(scored, trios.select("family", "trio_number", "trio"), ["family"], "left")
    typed = F.when(F.col("type").isin("6", "11"), 4).when(F.col("type").isNotNull(), 2).otherwise(1)
    scored = scored.withColumn("rank_type", typed)
    c = F.col
    score = ratio(
        c("quality") * c("quality") * c("express") * c("trio_number") * c("rank_type"),
        c("rank_chip") * c("rank_chip"),
    )
    return impute_low(scored.withColumn("score", score), "score")


def select_cohort(
    scored: DataFrame,
    keep: DataFrame,
    seed: int,
    n_main: int = 22,
    n_adult: int = 8,
    n_mild: int = 8,
    parents: DataFrame | None = None,
    excluded_families: Sequence[str] = (),
    n_parents: int = 0,
) -> DataFrame:
    """Draw the strata and unite them with the stocks that are kept anyway.

    Main draw by score, adult onset by score, mild course by score over squared expression; blood of both
    parents (`parents` holds the stocks of fathers and mothers) for `n_parents` complete trios of the main
    draw, by expression, without the excluded families. One row per stock with the strata it came from, in a
    fixed order.
    """
    c = F.col
    kept = keep.select("stock_id").distinct()
    fresh = salted_join(scored, kept, ["stock_id"], "left_anti")
    main = weighted_sample_n(fresh, n_main, c("score"), ["stock_id", "specimen_id"], seed)
    adult = weighted_sample_n(scored.filter(c("dx_age") > 18), n_adult, c("score"), ["stock_id", "specimen_id"], seed + 1)
    mild = fresh.filter(
        (c("dx_age") < 12)
        & (c("max_freq") < 4)
        & (c("surgeries") < 10)
        & (c("distal") == "cleardist")
        & (c("tracheostomy") == "Never")
        & c("annual_freq").isNotNull()
    )
    mild = weighted_sample_n(
        mild, n_mild, ratio(c("score"), c("express") * c("express")), ["stock_id", "specimen_id"], seed + 2
    )
    parts = {"adult": adult, "keep": kept, "main": main, "mild": mild}
    if parents is not None and n_parents:
        solid = main.filter((c("trio") == "trio") & (c("tissue") == "WB") & ~c("family").isin(*excluded_families))
        families = weighted_sample_n(solid, n_parents, c("express"), ["stock_id", "specimen_id"], seed + 3).select("family")
        blood = parents.filter(c("tissue") == "WB").withColumn("family", codes.family_of(c("subject_code")))
        parts["parents"] = blood.join(families, "family", "left_semi")
    tagged = [df.select("stock_id", F.lit(name).alias("stratum")) for name, df in parts.items()]
    return string_agg(union_distinct(*tagged), ["stock_id"], "stratum", "strata", ",")


def replacements(scored: DataFrame, drawn: DataFrame, failed: DataFrame, seed: int) -> DataFrame:
    """One new stock, drawn by score, for each failed one; no stock that was drawn before comes again."""
    pool = salted_join(scored, drawn.select("stock_id").distinct(), ["stock_id"], "left_anti")
    wanted = failed.select("stock_id").distinct().count()
    return weighted_sample_n(pool, wanted, F.col("score"), ["stock_id", "specimen_id"], seed)


def family_holdings(specimens: DataFrame) -> DataFrame:
    """Per family: tissue score, one plus parents' specimens, members, and the value of sampling it."""
    c = F.col
    role = F.substring("subject_code", 9, 2)
    out = specimens.groupBy(codes.family_of(c("subject_code")).alias("family")).agg(
        F.sum(recode(c("tissue"), TISSUE_SCORES, 0)).alias("tissue_score"),
        F.max((role == "FA").cast("int")).alias("father"),
        F.max((role == "MO").cast("int")).alias("mother"),
        F.count_distinct("subject_code").alias("members"),
    )
    out = out.withColumn("trio_number", 1 + c("father") + c("mother")).drop("father", "mother")
    value = ratio(F.pow(c("trio_number") - 1, F.lit(3.0)) * c("tissue_score") * c("tissue_score"), c("members"))
    return out.withColumn("value", value)


def select_families(
    specimens: DataFrame, n: int, seed: int, named: Sequence[str], done: DataFrame, tissues: Sequence[str] = ("MW", "WB")
) -> DataFrame:
    """Draw families by value and list all their usable specimens, plus those of named subjects, minus
    specimens already done."""
    drawn = weighted_sample_n(family_holdings(specimens), n, F.col("value"), ["family"], seed).select("family")
    members = specimens.withColumn("family", codes.family_of(F.col("subject_code")))
    usable = members.filter(F.col("tissue").isin(*tissues))
    of_drawn = usable.join(drawn, "family", "left_semi")
    of_named = members.filter((F.col("tissue") != "LRNXP") & F.col("subject_code").isin(*named))
    both = of_drawn.unionByName(of_named).select("specimen_id", "subject_code", "family", "tissue").distinct()
    return salted_join(both, done.select("specimen_id"), ["specimen_id"], "left_anti", hot=[])


def family_scores(rows: DataFrame) -> DataFrame:
    """Log of the product of member qualities times the best patient score, per family.

    A missing quality, or a product that is not positive, gives NULL. The logarithm keeps the product of
    a large family within range.
    """
    usable = (F.count("quality") == F.count("*")) & (F.min("quality") > 0) & (F.max("assay_score") > 0)
    log_product = F.sum(F.ln(F.when(F.col("quality") > 0, F.col("quality"))))
    best = F.max(F.when(F.col("assay_score") > 0, F.ln("assay_score")))
    return rows.groupBy("family").agg(F.when(usable, log_product + best).alias("log_score"))


def select_trios(
    scored: DataFrame,
    quality: DataFrame,
    excluded_families: DataFrame,
    done: DataFrame,
    n: int,
    seed: int,
    least_conc: float = 30.0,
) -> DataFrame:
    """Stocks of complete trios with enough DNA, families drawn by the product score."""
    c = F.col
    patients = scored.withColumn("assay_score", ratio(c("score"), c("express"))).withColumn(
        "relationship", F.lit(codes.PATIENT)
    )
    columns = ["subject_code", "relationship", "stock_id", "specimen_id", "conc", "quality"]
    rows = union_fill(
        patients.select(*columns, "assay_score", "trio"), quality.filter(c("relationship") != codes.PATIENT).select(*columns)
    ).withColumn("family", codes.family_of(c("subject_code")))
    rows = salted_join(rows, excluded_families.select("family"), ["family"], "left_anti")
    rows = salted_join(rows, done.select("stock_id").distinct(), ["stock_id"], "left_anti", hot=[])
    rows = rows.filter(~c("relationship").isin(codes.SIBLING, *codes.GRANDPARENTS))
    complete = rows.filter(c("trio") == "trio").select("family").distinct()
    rows = shared(salted_join(rows, complete, ["family"], "left_semi").filter(c("conc") >= least_conc), "trio-members")
    drawn = weighted_sample_n(family_scores(rows), n, c("log_score"), ["family"], seed, log_weight=True)
    return rows.select("family", "subject_code", "relationship", "stock_id", "specimen_id", "conc").join(
        drawn, "family"
    )


def locate_samples(wanted: DataFrame, plating: DataFrame) -> DataFrame:
    """Plate and well of each wanted stock, NULL where it is on no plate.

    The wells are cut down to the wanted stocks before the outer join; a short list is broadcast by its
    measured size.
    """
    ids = wanted.select("stock_id").distinct()
    found = plating.select("stock_id", "plate", "well").join(ids, "stock_id", "left_semi")
    return ids.join(found, "stock_id", "left")


def trio_worklist(chosen: DataFrame, people: DataFrame, measured: DataFrame, plating: DataFrame) -> DataFrame:
    """The worklist of chosen stocks: who they come from, what is in them, where they stand and what to
    pipette. A stock on several wells has a row for each, a stock on no plate a row without a well.

    The chosen list is short, so it cuts down people and stocks before anything is joined.
    """
    ids = shared(chosen.select("family", "subject_code", "relationship", "stock_id", "specimen_id"), "chosen")
    persons = people.join(ids.select("subject_code").distinct(), "subject_code", "left_semi")
    stock = measured.join(ids.select("specimen_id").distinct(), "specimen_id", "left_semi")
    located = locate_samples(ids, plating)
    out = ids.join(persons.select("subject_code", "sex", "ethnicity", "race"), "subject_code", "left")
    out = out.join(stock.select("specimen_id", "conc", "volume", "abs_ratio", "yield_ug"), "specimen_id", "left")
    return pipette_plan(out.join(located, "stock_id", "left"))


def marker_coverage(markers: DataFrame, proxies: DataFrame, chip: DataFrame) -> DataFrame:
    """Per marker: itself on the chip, else the proxies that are, else absent."""
    on_chip = chip.select("name").distinct()
    direct = salted_join(markers, on_chip.withColumnRenamed("name", "marker"), ["marker"], "left_semi", hot=[]).select(
        "marker", F.lit("direct").alias("coverage"), F.lit(None).cast("string").alias("by_proxy")
    )
    hits = salted_join(proxies.withColumnRenamed("proxy", "name"), on_chip, ["name"], "left_semi").distinct()
    by_proxy = string_agg(hits, ["marker"], "name", "by_proxy", ",")
    rest = markers.join(direct.select("marker"), "marker", "left_anti").join(by_proxy, "marker", "left")
    rest = rest.select("marker", F.when(F.col("by_proxy").isNotNull(), "proxy").otherwise("absent").alias("coverage"), "by_proxy")
    return direct.unionByName(rest)


def retest_worklist(typing: DataFrame, specimens: DataFrame, clear: Sequence[str], tissue: str = "LRNXP") -> DataFrame:
    """Stocks whose type is unclear, and stocks of the right tissue never typed."""
    unclear = typing.filter(F.col("type").isNull() | ~F.col("type").isin(*clear)).select(
        "stock_id", "subject_code", F.lit("unclear").alias("reason")
    )
    typed = typing.select("stock_id").filter(F.col("stock_id").isNotNull()).distinct()
    never = salted_join(specimens.filter(F.col("tissue") == tissue), typed, ["stock_id"], "left_anti").select(
        "stock_id", "subject_code", F.lit("never typed").alias("reason")
    )
    return unclear.unionByName(never)
