"""Composite plans on small families with the awkward cases planted."""

import datetime

import pytest
from pyspark.sql import functions as F

from kinsieve.functions import codes
from kinsieve.plans import cohort, integrity, plates, report, selection

D = datetime.date


# -- plates ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stocks(spark):
    rows = [(i, 10_000 + i, None if i == 5 else float((i * 37) % 211) + 0.5, "WB") for i in range(1, 301)]
    return spark.createDataFrame(rows, "stock_id long, specimen_id long, conc double, tissue string")


@pytest.mark.parametrize("size", [None, 23])
def test_layout(stocks, size):
    got = plates.plate_layout(stocks, 11, size).toPandas()
    assert len(got) == 300 + 4 and sorted(got["plate"].unique()) == [1, 2, 3, 4]
    for _, plate in got.groupby("plate"):
        assert len(plate) <= 96 and plate["well"].is_unique and plate["position"].between(1, 96).all()
        assert (plate["stock_id"] == 0).sum() == 1
    assert set(got[got["stock_id"] > 0]["stock_id"]) == set(range(1, 301))
    # filled in order of concentration, the unknown one last
    filled = got[got["stock_id"] > 0].sort_values(["plate", "position"])
    assert filled["conc"].dropna().is_monotonic_increasing and filled["stock_id"].iloc[-1] == 5


def test_layout_does_not_depend_on_the_cluster(stocks):
    one = sorted(map(str, plates.plate_layout(stocks, 11).collect()))
    assert one == sorted(map(str, plates.plate_layout(stocks.repartition(9), 11, 50).collect()))


def test_blank_well_at_either_end(spark, stocks, monkeypatch):
    for hole in (1, 96):
        monkeypatch.setattr(plates, "random_integer", lambda high, seed, *key, h=hole: F.lit(h))
        first = plates.plate_layout(stocks, 1).filter("plate = 1").toPandas()
        assert sorted(first["position"]) == list(range(1, 97))
        assert first[first["position"] == hole]["stock_id"].iloc[0] == 0


def test_dilution_rounds_halves_to_even_and_floors_at_zero(spark):
    stats = spark.createDataFrame([(1, 20.0), (2, 38.0), (3, 10.0), (4, 42.0), (5, None)], "plate long, median_conc double")
    got = {r.plate: (r.dna_to_add, r.water_to_add) for r in plates.dilution_volumes(stats).collect()}
    # 38 * 5 / 20 - 5 = 4.5 and goes to 4; 42 * 5 / 20 - 5 = 5.5 and goes to 6
    assert got == {1: (6, 0.0), 2: (5, 4.0), 3: (6, 0.0), 4: (5, 6.0), 5: (None, None)}


def test_medians_are_taken_after_rounding(spark):
    rows = [(1, "A1", 1, 7, 70, 10.4), (1, "B1", 2, 8, 80, 11.4)]
    layout = spark.createDataFrame(rows, "plate long, well string, position int, stock_id long, specimen_id long, raw double")
    layout = layout.select("plate", "well", "position", "stock_id", "specimen_id", F.rint("raw").alias("conc"))
    volumes = plates.dilution_volumes(plates.plate_stats(layout))
    assert volumes.collect()[0].median_conc == 10.5
    plan = {r.stock_id: (r.total_ng, r.total_ul, r.diluted_conc) for r in plates.dilution_plan(layout, volumes).collect()}
    assert plan == {7: (60.0, 6.0, 10.0), 8: (66.0, 6.0, 11.0)}


def test_pipetting_limits(spark):
    df = spark.createDataFrame([(c,) for c in (30.0, 49.9, 50.0, 75.0, 200.0, 36.3)], "conc double")
    got = {r.conc: (r.pip_stock, r.pip_diluent) for r in plates.pipette_plan(df).collect()}
    assert got[30.0] == (33.0, 0.0) and got[49.9] == (20.0, 0.0) and got[36.3] == (28.0, 0.0)
    # 750/50 = 15 ul would only fill to 10 at 75 ng/ul, so the target drops to 50 ng/ul
    assert got[50.0] == (15.0, 0.0)
    assert got[75.0] == (10.0, 5.0)
    assert got[200.0] == (5.0, 15.0)


def test_qc_comparison(spark):
    rep = spark.createDataFrame([("1A", 3200.0, True, "G", None), ("1B", 640.0, False, None, None), ("9Z", 1.0, True, "G", "C")], "position string, copies double, passed boolean, snp_1 string, snp_2 string")
    sent = spark.createDataFrame([("1A", 10.0, "WB"), ("1B", 20.0, "MW")], "position string, conc double, tissue string")
    got = {r.position: (r.qc_conc, r.missing_calls, r.rank_diff) for r in plates.qc_join(rep, sent, ["snp_1", "snp_2"]).collect()}
    assert got == {"1A": (5.0, 1, -1.0), "1B": (1.0, 2, 1.0)}


# -- typing ---------------------------------------------------------------------------------------


def test_typing_merge(spark):
    seq = spark.createDataFrame([(5, "AAA00001PT", "6"), (4, "AAA00001PT", "11"), (9, "BBB00002PT", None)], "stock_id long, subject_code string, type string")
    early = spark.createDataFrame([(4, "AAA00001PT", "6"), (7, "CCC00003PT", "weird")], "stock_id long, subject_code string, type string")
    given = spark.createDataFrame([("BBB00002PT", "11"), ("DDD00004PT", "16")], "subject_code string, type string")
    stacked = cohort.stack_typing({"seq": seq, "early": early, "given": given})
    once = {r.subject_code: (r.type, r.source) for r in cohort.typing_once(stacked).collect()}
    assert once == {"AAA00001PT": ("11", "seq"), "BBB00002PT": (None, "seq"), "CCC00003PT": ("weird", "early"), "DDD00004PT": ("16", "given")}
    again = {(r.subject_code, r.stock_id): (r.seq, r.early, r.given) for r in cohort.typing_repeats(stacked, ["seq", "early", "given"]).collect()}
    assert again == {
        ("AAA00001PT", 4): ("11", "6", None), ("AAA00001PT", 5): ("6", None, None),
        ("BBB00002PT", 9): (None, None, None), ("BBB00002PT", None): (None, None, "11"),
    }
    patients = spark.createDataFrame([("AAA00001PT",), ("CCC00003PT",), ("EEE00005PT",)], "subject_code string")
    typed = {r.subject_code: r.type for r in cohort.add_typing(patients, cohort.typing_once(stacked)).collect()}
    assert typed == {"AAA00001PT": "11", "CCC00003PT": None, "EEE00005PT": None}


# -- people ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def views(spark):
    log = spark.createDataFrame(
        [
            ("AAA00001PT", "Female", None, "Hispanic", D(1990, 1, 1), D(2008, 1, 1)),
            ("BBB00002PT", None, "Black", None, None, None),
        ],
        "subject_code string, sex string, race string, ethnicity string, dob date, spec_date date",
    )
    S = [
        # id, stock, code, tissue, collected, received, keyed, sex, dob
        (1, 11, "AAA00001PT", "WB", D(2008, 1, 2), D(2008, 1, 5), D(2008, 2, 1), "F", None),
        (2, 12, "AAA00001PT", "WB", D(2007, 12, 1), D(2008, 1, 5), None, "F", None),
        (3, 13, "AAA00001FA", "MW", None, D(2008, 1, 5), None, "F", None),
        (4, 14, "AAA00001MO", "MW", None, None, None, "F", D(1960, 1, 1)),
        (5, 15, "AAA00001S1", "MW", D(2008, 1, 9), D(2008, 1, 7), None, "M", None),
        (6, 15, "AAA00001S200512", "MW", D(2004, 1, 1), None, None, None, None),
        (7, 17, "BBB00002PT", "LRNXP", D(2010, 5, 5), None, None, "M", D(1992, 5, 5)),
        (8, 18, "BBB00002S1", "BUC", D(2010, 5, 5), None, None, "M", None),
        (9, 19, "CCC00003PT", "WB", D(2010, 5, 5), None, None, "M", None),
    ]
    specimens = spark.createDataFrame(
        S, "specimen_id long, stock_id long, subject_code string, tissue string, collect_date date, recd_date date, keyed_date date, subj_sex string, subj_dob date"
    )
    return log, specimens, cohort.specimen_view(log, specimens)


@pytest.mark.parametrize("size", [None, 2])
def test_person_view(views, size):
    _, _, by_specimen = views
    people = {r.subject_code: r for r in cohort.person_view(by_specimen, rows_per_bucket=size).collect()}
    assert len(people) == 8
    pt = people["AAA00001PT"]
    # earliest specimen wins; 17.9 years at its collection
    assert pt.enroll_date == D(2007, 12, 1) and pt.age == 17.9 and pt.age_class == "child"
    # parents are adults without a date of birth; siblings follow their own family's patient
    assert people["AAA00001FA"].age_class == "adult" and people["AAA00001FA"].age is None
    assert people["AAA00001S1"].age_class == "child" and people["BBB00002S1"].age_class == "child"
    # exactly 18.0 is still a child
    assert people["BBB00002PT"].age == 18.0 and people["BBB00002PT"].age_class == "child"
    assert people["AAA00001S200512"].dob == D(2005, 12, 15)
    # race and ethnicity travel through the family, never across families
    assert people["AAA00001FA"].ethnicity == "Hispanic" and people["AAA00001FA"].race is None
    assert people["BBB00002S1"].race == "Black" and people["CCC00003PT"].race is None
    assert people["AAA00001S1"].sex == "Male" and pt.sex == "Female" and people["AAA00001S200512"].sex is None
    assert people["AAA00001S1"].relationship == "SI"


def test_integrity_checks(spark, views):
    log, specimens, view = views
    found = lambda df: sorted((r.check_name, r.subject_code, r.detail) for r in df.collect())
    assert found(integrity.missing_in_log(specimens, log)) == [("missing_in_log", "CCC00003PT", None)]
    updates = spark.createDataFrame([("AAA00001PT", D(2009, 1, 1)), ("AAA00001PT", D(2010, 1, 1)), ("BBB00002PT", None)], "subject_code string, update_date date")
    assert len(found(integrity.duplicate_updates(updates))) == 2
    assert found(integrity.specimens_without_date(view)) == [("no_date", "AAA00001MO", "4")]
    study = spark.createDataFrame([("AAA00001PT", "RP"), ("AAA00001PT", "X"), ("A1", "RPREL"), ("A2", "X")], "subject_code string, study_code string")
    assert found(integrity.study_code_mismatch(study, ("RP", "RPREL"))) == [("code_in_foreign_study", "AAA00001PT", "X"), ("odd_code_in_study", "A1", "RPREL")]
    assert found(integrity.parent_sex_contradiction(specimens)) == [("parent_sex", "AAA00001FA", "F")]
    people = view.withColumn("dob", F.coalesce("dob", "subj_dob", codes.sibling_birth_date(F.col("subject_code"))))
    assert found(integrity.born_after_collection(people)) == [("born_after_collection", "AAA00001S200512", "2005-12-15")]
    assert found(integrity.received_before_collected(view)) == [("received_before_collected", "AAA00001S1", "-2")]
    assert found(integrity.duplicate_stock(specimens)) == [("duplicate_stock", "AAA00001S1", "15"), ("duplicate_stock", "AAA00001S200512", "15")]
    assert found(integrity.enrolment_gap(view)) == [("enrolment_gap", "AAA00001PT", "31")]
    thrice = view.unionByName(view).unionByName(view)
    names = {r[0] for r in found(integrity.too_many_specimens(thrice))}
    assert names == {"more_than_two", "more_than_one_relative"}
    assert found(integrity.too_many_specimens(view)) == []
    affected = spark.createDataFrame([("a", None, "X", 3), ("b", None, "ASRI", 9), ("c", "prn", "X", None), ("d", None, "X", 2)], "subject_code string, surg_style string, site_code string, surg_life int")
    assert found(integrity.missing_style(affected, "ASRI")) == [("missing_style", "a", "X")]
    assert found(integrity.missing_surgeries(affected)) == [("missing_surgeries", "c", "X")]


def test_severity(spark):
    columns = "subject_code string, spec_date date, update_date date, trach_log string, trach_upd string, site_pulmonary int, site_bronchus int, site_trachea int, ever_distal int, below_voice_box string, surg_life int, surg_life_upd int, surg_12m int, surg_12m_upd int, surg_max_12m int, dx_date date"
    rows = [
        # worst ever wins over the later "Never"; involved beats clear
        ("a", D(2005, 1, 1), D(2006, 1, 1), "Used to have", "Never", 0, 0, None, 1, "No", 4, 9, 1, None, 2, D(2000, 1, 15)),
        # seen 10 days before the imputed day of diagnosis: follow-up becomes zero, no yearly average
        ("b", D(2000, 1, 5), None, "Never", None, None, None, None, 0, "Unsure", 3, None, 0, None, None, D(2000, 1, 15)),
        # nothing known
        ("c", None, None, None, None, None, None, None, None, "Not Recorded", None, None, None, None, None, None),
        # eight months of follow-up are too short for an average
        ("d", D(2000, 9, 15), None, "Never", None, 0, 0, 0, 0, "Yes, lungs", 12, None, 3, None, None, D(2000, 1, 15)),
    ]
    got = {r.subject_code: r for r in cohort.severity(spark.createDataFrame(rows, columns)).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.tracheostomy, a.distal, a.surgeries, a.last_contact, a.aggressive) == ("trached", "involvdist", 9, D(2006, 1, 1), True)
    assert (a.follow_up, a.annual_freq, a.max_freq) == (5.96, 1.5, 2.0)
    assert (b.follow_up, b.annual_freq, b.max_freq, b.distal, b.tracheostomy, b.aggressive) == (0.0, None, 1.0, "cleardist", "Never", False)
    assert (c.tracheostomy, c.distal, c.max_freq, c.aggressive, c.last_contact) == (None, None, None, None, None)
    assert (d.annual_freq, d.distal, d.aggressive) == (None, "involvdist", True)


def test_updates_join_keeps_patients_without_update(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2)], "subject_code string, x int")
    updates = spark.createDataFrame([("a", 10), ("a", 11), ("z", 12)], "subject_code string, u int")
    got = sorted(((r.subject_code, r.x, r.u) for r in cohort.affected_view(log, updates).collect()), key=str)
    assert got == [("a", 1, 10), ("a", 1, 11), ("b", 2, None)]


def test_durations(spark):
    df = spark.createDataFrame([(D(2008, 1, 1), D(1990, 1, 1), D(2009, 1, 1), D(1965, 1, 15), 17), (D(2008, 1, 1), None, None, None, None)], "dx_date date, dob date, enroll_date date, mother_dob date, mother_debut_age int")
    got = cohort.life_durations(df).collect()
    # 18.00 years counts as adult onset
    assert (got[0].dx_age, got[0].onset, got[0].enroll_age, got[0].mother_age) == (18.0, "adult", 19.0, 24.96)
    assert got[0].debut_to_birth == 7.46 and got[1].onset is None


# -- selection ------------------------------------------------------------------------------------


def test_trio_status_and_holdings(spark):
    rows = [("AAA00001PT", "WB"), ("AAA00001PT", "LRNXP"), ("AAA00001FA", "MW"), ("AAA00001FA", "MW"), ("AAA00001MO", "BUC"), ("BBB00002PT", "WB"), ("CCC00003PT", "??"), ("CCC00003MO", "MW")]
    df = spark.createDataFrame(rows, "subject_code string, tissue string")
    members = df.select(codes.family_of(F.col("subject_code")).alias("family"), codes.relationship_of(F.col("subject_code")).alias("relationship"))
    assert {r.family: r.trio for r in selection.trio_status(members).collect()} == {"AAA00001": "trio", "BBB00002": "solo", "CCC00003": "duo"}
    got = {r.family: (r.tissue_score, r.members, r.trio_number, r.value) for r in selection.family_holdings(df).collect()}
    assert got == {"AAA00001": (26, 3, 3, pytest.approx(8 * 26 * 26 / 3)), "BBB00002": (10, 1, 1, 0.0), "CCC00003": (4, 2, 2, 8.0)}


def test_missing_scores_take_a_low_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10, 111, 10)] + [(None,)], "s double")
    got = sorted(r.s for r in selection.impute_low(df, "s").collect())
    assert got[:3] == [10.0, 20.0, 20.0]


def test_quality_prefers_blood_and_floors_empty_stocks(spark):
    rows = [(1, "WB", 50.0, 100.0, 1.9), (2, "WB", 60.0, 100.0, 1.7), (3, "MW", 0.0, 10.0, 1.8), (4, "MW", 40.0, 100.0, 1.8), (5, "BUC", 9.0, 9.0, 1.8)]
    stock = selection.stock_measures(spark.createDataFrame(rows, "stock_id long, tissue string, conc double, volume double, abs_ratio double"))
    got = {r.stock_id: r.quality for r in selection.quality_score(stock).collect()}
    assert set(got) == {1, 2, 3, 4}
    # average ranks: mouthwash 1.5, blood 3.5
    assert got[3] == pytest.approx(0.0001 * 1.5**2) and got[4] == pytest.approx(4.0 / 0.1 * 1.5**2)
    assert got[1] == pytest.approx(10.0 * 3.5**2) and got[2] == pytest.approx(1 / 0.2 * 3.5**2)


def test_family_score_is_voided_by_a_missing_quality(spark):
    rows = [("f", 2.0, 5.0), ("f", 3.0, None), ("g", 2.0, 5.0), ("g", None, None), ("h", 1e200, 1e200), ("h", 1e200, None)]
    got = {r.family: r.log_score for r in selection.family_scores(spark.createDataFrame(rows, "family string, quality double, assay_score double")).collect()}
    import math

    assert got["f"] == pytest.approx(math.log(30)) and got["g"] is None and got["h"] == pytest.approx(3 * math.log(1e200))


def test_locating_and_markers(spark):
    plating = spark.createDataFrame([(1, 1, "A1"), (2, 1, "B1"), (2, 3, "C1")], "stock_id long, plate long, well string")
    wanted = spark.createDataFrame([(2,), (2,), (9,)], "stock_id long")
    got = sorted(map(tuple, selection.locate_samples(wanted, plating).collect()), key=str)
    assert got == [(2, 1, "B1"), (2, 3, "C1"), (9, None, None)]
    markers = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "marker string")
    proxies = spark.createDataFrame([("m1", "p1"), ("m2", "p2"), ("m2", "p1"), ("m2", "p2"), ("m3", "p9")], "marker string, proxy string")
    chip = spark.createDataFrame([("m1",), ("p1",), ("p2",)], "name string")
    got = {r.marker: (r.coverage, r.by_proxy) for r in selection.marker_coverage(markers, proxies, chip).collect()}
    assert got == {"m1": ("direct", None), "m2": ("proxy", "p1,p2"), "m3": ("absent", None)}


def test_retest_and_exclusions(spark):
    typing = spark.createDataFrame([(1, "a", "6"), (2, "b", "16"), (None, "c", None)], "stock_id long, subject_code string, type string")
    specimens = spark.createDataFrame([(1, "a", "LRNXP"), (3, "d", "LRNXP"), (4, "e", "WB"), (None, "f", "LRNXP")], "stock_id long, subject_code string, tissue string")
    got = {(r.subject_code, r.reason) for r in selection.retest_worklist(typing, specimens, ["6", "11"]).collect()}
    assert got == {("b", "unclear"), ("c", "unclear"), ("d", "never typed"), ("f", "never typed")}
    people = spark.createDataFrame([("AAA00001PT",), ("BBB00002PT",)], "subject_code string")
    # a prefix that matches nothing drops nothing
    assert report.without_prefixes(people, ["ZZZ"]).count() == 2 and report.without_prefixes(people, ["AAA"]).count() == 1


def test_family_composition_counts_families(spark):
    rows = ["AAA00001PT", "AAA00001MO", "BBB00002PT", "BBB00002MO", "CCC00003PT", "DDD00004S1", "DDD00004S2"]
    got = {r.relationships: (r.n, r.share) for r in report.family_composition(spark.createDataFrame([(r,) for r in rows], "subject_code string")).collect()}
    assert got == {"MO, PT": (2, 0.5), "PT": (1, 0.25), "SI, SI": (1, 0.25)}


# -- stages of the worklists ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["locate_samples", "trio_worklist"])
def test_stocks_are_measured_once(spark, monkeypatch, name):
    from kinsieve import catalog
    from kinsieve.catalog import composite

    catalog.load_all()
    calls, plain = [], composite.stocks
    monkeypatch.setattr(composite, "stocks", lambda *args: calls.append(args) or plain(*args))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_latest_updates_are_those_of_all_updates(spark):
    from kinsieve.catalog.standins import clinical_updates
    from kinsieve.operators.joins import first_per_key
    from kinsieve.operators.ordered import desc

    folder = "/root/testdata/sf0.001"
    want = first_per_key(clinical_updates(spark, folder), ["subject_code"], [desc("update_id")])
    got = clinical_updates(spark, folder, latest=True)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
