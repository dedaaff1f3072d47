import pytest
from pyspark.sql import functions as F

from cohortkit.operators import cohort, exposure, rules
from cohortkit.sources import lookups

DRUGS = ("person_id long, drug_exposure_start_date date, drug_exposure_end_date date, "
         "drug_concept_id int, drug_concept_name string, route_concept_id int")


@pytest.fixture
def members(spark, day):
    return spark.createDataFrame([(1, day(0)), (2, day(0))], "person_id long, index_start date")


def concepts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "concept_id int")


def test_base_cohort(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "person_id long, hospitalized int")
    assert [r.person_id for r in cohort.base_cohort(df).collect()] == [1]


def test_calendar_has_22_days(spark, members, day):
    got = cohort.index_calendar(members).where("person_id = 1").orderBy("hospital_day").collect()
    assert [r.hospital_day for r in got] == list(range(22))
    assert got[0].date == day(0) and got[21].date == day(21)


def test_concept_set_versions(spark, rows):
    for kind, yes, no in (("boolean", True, False), ("string", "true", "false")):
        m = spark.createDataFrame([(1, "a", 10, yes), (1, "a", 11, no), (2, "b", 12, yes)],
                                  f"codeset_id int, concept_set_name string, concept_id int, "
                                  f"is_most_recent_version {kind}")
        assert rows(cohort.concept_set(m, 1)) == [(10,)]
        assert rows(cohort.concept_set(m, 1, latest=False)) == [(10,), (11,)]
        assert rows(cohort.concept_set(m, set_name="b")) == [(12,)]
    with pytest.raises(ValueError):
        cohort.concept_set(m)


@pytest.mark.parametrize("start,end,days", [
    (0, None, [0]), (21, None, [21]), (22, None, []), (-1, None, []),
    (3, 1, []), (-1, -2, []), (-5, 40, list(range(22))), (2, 4, [2, 3, 4]), (20, 25, [20, 21]),
    (-3, 0, [0]), (-3, -1, []), (5, 5, [5]),
])
def test_exposure_days_edges(spark, members, day, start, end, days):
    e = spark.createDataFrame(
        [(1, day(start), None if end is None else day(end), 7, "x", 0)], DRUGS)
    got = exposure.exposure_days(e, members, concepts(spark, 7)).collect()
    assert sorted(r.hospital_day for r in got) == days
    if got:
        assert got[0].asDict().keys() == {*e.columns, "hospital_day"}


def test_exposure_days_keeps_overlaps_and_filters(spark, members, day, rows):
    e = spark.createDataFrame([
        (1, day(0), day(1), 7, "x", 0), (1, day(1), day(2), 7, "x", 0),   # both cover day 1
        (1, day(0), day(1), 8, "y", 0),                                    # not listed
        (9, day(0), day(1), 7, "x", 0)], DRUGS)                            # not a member
    got = exposure.exposure_days(e, members, concepts(spark, 7))
    assert rows(got, "person_id", "hospital_day") == [(1, 0), (1, 1), (1, 1), (1, 2)]


def test_exposure_days_empty(spark, members):
    assert exposure.exposure_days(spark.createDataFrame([], DRUGS), members,
                                  concepts(spark, 7)).count() == 0


def routed(spark, *flags):
    return spark.createDataFrame(list(flags), "person_id long, hospital_day int, "
                                 "is_enteral boolean, is_parenteral boolean")


def test_by_day_and_summary(spark, rows):
    r = routed(spark, (1, 0, True, False), (1, 0, False, True), (1, 5, False, False),
               (1, 6, True, None), (2, 9, True, True))
    by_day = exposure.exposures_by_day(r)
    assert rows(by_day) == [(1, 0, 1, 1), (1, 5, 0, 0), (1, 6, 1, 0), (2, 9, 1, 1)]
    got = {x.person_id: x for x in exposure.exposure_summary(by_day).collect()}
    one = got[1]
    assert (one.parenteral_days_to_day_4, one.parenteral_days_to_day_6) == (1, 1)
    assert (one.any_days_to_day_4, one.any_days_to_day_5, one.any_days_to_day_6) == (1, 1, 2)
    # no exposed day up to the cutoff: NULL, not 0
    assert got[2].any_days_to_day_6 is None


def test_early_use(spark, rows):
    x = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 2), (2, 2)],
                              "person_id long, hospital_day int")
    assert rows(exposure.early_use_count(x)) == [(1, 3)]


# --- routes, cascade, labels ------------------------------------------------

ENTERAL, PARENTERAL, MISSING, UNFLAGGED = 4132161, 4171047, 0, 4263689


def test_route_table(spark):
    routes = lookups.lookup_table(spark, "routes")
    assert routes.count() == 82 and routes.select("concept_id").distinct().count() == 82
    count = lambda c: routes.where(c).count()
    assert (count("is_parenteral"), count("is_enteral"), count("is_missing")) == (16, 19, 3)
    assert count("is_parenteral = false") == 0
    assert lookups.lookup_table(spark, "labs").count() == 6
    states = lookups.lookup_table(spark, "states")
    assert states.count() == 51 and states.select("division").distinct().count() == 9
    assert len(lookups.DRUG_LABELS) == 58 and len(set(lookups.DRUG_LABELS)) == 55
    assert len(lookups.LATE_INFECTION_CONCEPTS) == 28


def exposures(spark, *rows):
    return spark.createDataFrame(
        [(i, 0, *r) for i, r in enumerate(rows)],
        "person_id long, hospital_day int, drug_concept_id int, drug_concept_name string, "
        "route_concept_id int")


def test_route_rates(spark):
    routes = lookups.lookup_table(spark, "routes")
    x = exposures(spark, *[(5, "d", ENTERAL)] * 9, (5, "d", PARENTERAL), (5, "d", MISSING),
                  (5, "d", UNFLAGGED), (5, "d", None), (5, "d", 12345), (6, "e", MISSING))
    got = rules.route_rates(x, routes).collect()
    assert len(got) == 1                      # a drug without a known route has no row
    assert (got[0].drug_concept_id, got[0].occurrence_count) == (5, 10)
    assert (got[0].enteral_rate, got[0].parenteral_rate) == (0.9, 0.1)


def test_rule_cascade(spark):
    routes = lookups.lookup_table(spark, "routes")
    rates = spark.createDataFrame([(1, 100, 0.9, 0.1), (2, 100, 0.91, 0.09), (3, 5, 0.0, 1.0),
                                   (9, 5, 0.95, 0.0)],
                                  "drug_concept_id int, occurrence_count long, "
                                  "enteral_rate double, parenteral_rate double")
    x = exposures(
        spark, (1, "plain", ENTERAL), (1, "plain", PARENTERAL), (1, "plain", MISSING),
        (2, "plain", None), (4, "AMOX 250 MG Oral TABLET", MISSING),
        (3, "x oral capsule", UNFLAGGED), (1734104, "zzz", MISSING), (1736887, "zzz", MISSING),
        (5, None, MISSING), (9, "Injection", MISSING))
    got = {r.person_id: (r.is_enteral, r.is_enteral_strategy, r.is_parenteral,
                         r.is_parenteral_strategy)
           for r in rules.rule_cascade(x, routes, rates).collect()}
    assert got[0] == (True, 1, False, 1)
    assert got[1] == (False, 1, True, 1)
    assert got[2] == (False, 5, False, 5)     # a rate of exactly 0.9 does not decide
    assert got[3] == (True, 2, False, 5)
    assert got[4] == (True, 3, False, 5)
    assert got[5] == (True, 3, True, 2)       # the two flags are decided independently
    assert got[6] == (True, 4, False, 5)
    assert got[7] == (False, 5, True, 4)
    assert got[8] == (False, 5, False, 5)
    assert got[9] == (True, 2, True, 3)


def test_unmapped_and_named(spark, rows):
    routed = spark.createDataFrame([(1, "a", False, False), (1, "b", False, False),
                                    (2, "c", True, False), (3, "d", False, False)],
                                   "drug_concept_id int, drug_concept_name string, "
                                   "is_enteral boolean, is_parenteral boolean")
    got = [tuple(r) for r in rules.unmapped_frequency(routed).collect()]
    assert got == [(1, "b", 2), (3, "d", 1)]
    rates = spark.createDataFrame([(1, 5, 1.0, 0.0), (2, 9, 1.0, 0.0)],
                                  "drug_concept_id int, occurrence_count long, "
                                  "enteral_rate double, parenteral_rate double")
    names = spark.createDataFrame([(1, "one")], "concept_id int, concept_name string")
    got = rules.route_rates_named(rates, names).collect()
    assert [(r.drug_concept_id, r.concept_name) for r in got] == [(2, None), (1, "one")]


@pytest.mark.parametrize("text,label", [
    ("Ciprofloxacin 500 MG", "ciprofloxacin"), ("LEVOFLOXACIN", "levofloxacin"),
    ("ofloxacin otic", "ofloxacin"), ("amoxicillin / clavulanate", "amoxicillin"),
    ("sulbactam", "DROP"), ("sulfamethoxazole / trimethoprim", "sulfamethoxazole"),
    ("something else", None), (None, None), ("tazobactam / piperacillin", "piperacillin"),
])
def test_first_match(spark, text, label):
    df = spark.createDataFrame([(text,)], "drug_concept_name string")
    assert rules.first_match_label(df).first().drug_name == label


def test_labelled_days(spark, rows):
    x = spark.createDataFrame([(1, 0, 7), (1, 0, 7), (1, 0, 8), (1, 1, 9), (2, 0, 10)],
                              "person_id long, hospital_day int, drug_concept_id int")
    names = spark.createDataFrame([(7, "a"), (8, "a"), (9, "DROP"), (10, None)],
                                  "drug_concept_id int, drug_name string")
    days = rules.labelled_person_day(x, names)
    assert rows(days) == [(1, 0, "a")]
    assert rows(rules.label_counts_by_day(days.union(days.select(F.lit(3), "hospital_day",
                                                                 "drug_name")))) == [(0, "a", 2)]
