from datetime import date
from functools import partial

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import analysis, trends
from cohortkit.plans.study import FACT_COLUMNS, Study, StudyParams, published_sources
from cohortkit.sources.lookups import SCORE_COMPONENTS, lookup_table

STEMS = [s for steps in SCORE_COMPONENTS.values() for s, _ in steps] + ["OBESITY", "TOBACCOSMOKER"]


def people(spark, *rows):
    """Rows are dicts; indicator columns default to 0."""
    base = {"person_id": 0, "age": 40}
    cols = [s + k for s in STEMS for k in (analysis.BEFORE, analysis.POST)]
    return spark.createDataFrame([{**base, **dict.fromkeys(cols, 0), **r} for r in rows])


@pytest.mark.parametrize("given,points,total", [
    ({"age": 49}, {"CCI_age": 0}, 0), ({"age": 50}, {"CCI_age": 1}, 1),
    ({"age": 79}, {"CCI_age": 3}, 3), ({"age": 80}, {"CCI_age": 4}, 4),
    ({"age": None}, {"CCI_age": 0}, 0),
    ({"DIABETESCOMPLICATED_post_covid_indicator": 1,
      "DIABETESUNCOMPLICATED_before_covid_indicator": 1}, {"CCI_diabetes": 2}, 2),
    ({"MALIGNANTCANCER_post_covid_indicator": 1}, {"CCI_cancer": 2}, 2),
    ({"MODERATESEVERELIVERDISEASE_post_covid_indicator": 3}, {"CCI_liver": 2}, 2),
    ({"MODERATESEVERELIVERDISEASE_post_covid_indicator": 1}, {"CCI_liver": 0}, 0),
    ({"MODERATESEVERELIVERDISEASE_before_covid_indicator": 1,
      "MILDLIVERDISEASE_before_covid_indicator": 1}, {"CCI_liver": 2}, 2),
    ({"OBESITY_before_covid_indicator": 1}, {}, 0),
])
def test_weighted_score(spark, given, points, total):
    frame = people(spark, {"age": 30, **given}, {"person_id": 1})
    got = analysis.weighted_score(frame).where("person_id = 0").first()
    assert {k: got[k] for k in points} == points and got.CCI == total


def test_score_strict(spark):
    frame = people(spark, {"MODERATESEVERELIVERDISEASE_post_covid_indicator": 1})
    assert analysis.weighted_score(frame, as_published=False).first().CCI == 2


def wide(spark, *rows):
    """(site, month, times) -> a minimal frame for the exclusion rules."""
    return spark.createDataFrame(
        [(site, month) for site, month, n in rows for _ in range(n)],
        "data_partner_id int, reporting_period date")


def test_exclusions(spark, rows):
    df = wide(spark, (1, date(2020, 2, 1), 500), (2, date(2020, 2, 1), 500),
              (1, date(2020, 3, 1), 1), (2, date(2022, 7, 1), 0), (1, date(2022, 6, 1), 0))
    # 501 rows against 500: the count covers all months, the threshold is strict
    got = analysis.eligible(df, "2020-03-01", "2022-07-01", 500)
    assert rows(got) == [(1, date(2020, 3, 1))]
    edge = wide(spark, (1, date(2022, 6, 1), 2), (1, date(2022, 7, 1), 2))
    assert rows(analysis.eligible(edge, "2020-03-01", "2022-07-01", 3)) == \
        [(1, date(2022, 6, 1))] * 2
    counts = trends.partner_counts(edge)
    assert analysis.eligible(edge, "2020-03-01", "2022-07-01", 3, counts).count() == 2
    assert analysis.eligible(edge, "2020-03-01", "2022-07-01", 4).count() == 0


def test_prefix_region(spark, rows):
    zips = spark.createDataFrame(
        [("12345", "NY")] * 3 + [("12399", "VT")] + [("45600", "OH"), ("45611", "KY")]
        + [("99999", "??")], "postal_code string, state string")
    states = lookup_table(spark, "states")
    least = {r.prefix: r for r in analysis.prefix_region(zips, states).collect()}
    assert least["123"].state == "VT" and least["123"].division == "New England"
    assert least["456"].state == "KY"                       # tie: first by name
    assert least["999"].region is None
    most = {r.prefix: r.state for r in analysis.prefix_region(zips, states, order="desc").collect()}
    assert most["123"] == "NY" and most["456"] == "KY"
    with pytest.raises(ValueError):
        analysis.prefix_region(zips, states, order="up")


def published(spark, day):
    """Two hospitalised people and one other, in the published table layout."""
    blank = {raw: None for raw in FACT_COLUMNS}
    facts = []
    for i, hosp in ((1, 1), (2, 1), (3, 0)):
        facts.append({**{s + k: 0 for s in STEMS for k in (analysis.BEFORE, analysis.POST)},
                      **blank, "person_id": i, "data_partner_id": 7, "age_at_covid": 60.0 + i,
                      "gender_concept_name": "MALE" if i == 1 else "No matching concept",
                      "race_ethnicity": "x", "sdoh2": 1.5, "postal_code": "10001",
                      "first_COVID_hospitalization_start_date": day(0),
                      "first_COVID_hospitalization_end_date": day(12),
                      "COVID_first_PCR_or_AG_lab_positive": day(0),
                      "COVID_first_diagnosis_date": day(0),
                      "COVID_first_poslab_or_diagnosis_date": day(0),
                      "COVID_associated_hospitalization_indicator": hosp,
                      "COVID_patient_death_during_covid_hospitalization_indicator": i % 2,
                      "LL_ECMO_during_covid_hospitalization_indicator": 0,
                      "LL_IMV_during_covid_hospitalization_indicator": 1,
                      "REMDISIVIR_during_covid_hospitalization_indicator": 0,
                      "COVIDREGIMENCORTICOSTEROIDS_during_covid_hospitalization_indicator": 1,
                      "BMI_max_observed_or_calculated_before_covid": 31.0,
                      "BMI_max_observed_or_calculated_post_covid": 33.0})
    make = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    tables = {
        "covid_facts": spark.createDataFrame(facts),
        "drug_exposure": make(
            "person_id long, drug_exposure_start_date date, drug_exposure_end_date date, "
            "drug_concept_id int, drug_concept_name string, route_concept_id int",
            (1, day(0), day(4), 100, "Vancomycin Injection", 0),
            (2, day(1), None, 101, "amoxicillin oral", 4132161),
            (1, day(9), day(9), 102, "meropenem", 4171047), (1, day(0), day(0), 103, "pressor", 0)),
        "measurement": make(
            "measurement_id long, person_id long, measurement_concept_id int, "
            "harmonized_value_as_number double, measurement_date date, "
            "measurement_datetime timestamp",
            (1, 1, 3010813, 11.0, day(0), None), (2, 1, 44817130, 0.6, day(1), None)),
        "condition_occurrence": make(
            "person_id long, condition_concept_id int, condition_concept_name string, "
            "condition_start_date date", (1, 50, "fall", day(-2)), (2, 193688, "late", day(8))),
        "procedure_occurrence": make(
            "person_id long, procedure_concept_id int, procedure_date date",
            *[(1, 60, day(i)) for i in range(13)], (2, 61, day(2)), (3, 61, day(0))),
        "observation": make("person_id long, observation_concept_id int, observation_date date",
                            (2, 50, day(7))),
        "concept_set_members": make(
            "codeset_id int, concept_set_name string, concept_id int, "
            "is_most_recent_version boolean",
            (54810628, "abx", 100, True), (54810628, "abx", 101, True),
            (54810628, "abx", 102, False), (192654943, "ext", 102, True),
            (593515761, "vaso", 103, True), (1, "[ICU/MODS]IMV", 60, True),
            (2, "Kostka - ECMO", 62, True)),
        "concept": make("concept_id int, concept_name string", (50, "fall")),
        "zip_codes": make("postal_code string, admin_code1 string", ("10002", "NY")),
        "Snomed_concepts_for_ccsr_injury_groups": make("concept_id int", (50,)),
        "Concepts_major_procedures": make("concept_id int", (61,)),
    }
    return Study(published_sources(tables.__getitem__), partial(lookup_table, spark),
                 StudyParams(min_site_rows=1, long_episode=13))


def test_published_layout_end_to_end(spark, day, rows):
    study = published(spark, day)
    got = {r.person_id: r for r in study.main.collect()}
    assert set(got) == {1, 2}
    a, b = got[1], got[2]
    assert (a.age, a.CCI, a.gender_concept_name) == (61, 2, "MALE")
    assert b.gender_concept_name == "UNKNOWN_OTHER"
    assert (a.region, a.division) == ("Northeast", "Middle Atlantic")
    assert (a.target, a.exposure_days, a.outcome_iv_day4) == (1, 5, 1)
    assert (b.target, b.outcome_any_day5, b.exposure_days) == (0, 0, 0)
    assert (a.wbc, a.pct_group, b.pct_group) == (11.0, "high", "not measured")
    assert (a.early_imv, a.early_ecmo, a.long_imv) == (1, 0, 1)
    assert (a.early_trauma_dx_count, b.early_trauma_obs_count) == (1, 1)
    assert (a.late_antibiotic_exposure, a.early_vasopressor_use) == (1, 1)
    assert (b.early_major_procedure, a.early_major_procedure) == (1, 0)
    assert (a.late_cdad, b.late_cdad) == (0, 1)
    assert (a.hospital_mortality, a.primary_outcome, b.primary_outcome) == (1, 1, 0)
    assert a.total_length_of_stay == 12 and a.bmi == 31.0
    assert a.reporting_period == date(2020, 6, 1)
    assert rows(study.label_counts.where("hospital_day = 0")) == [(0, "vancomycin", 1)]
    assert rows(study.course_for_cohort) == [(1, 1, 4), (2, 0, 0)]
    assert study.sensitivity.count() == 2
    assert study.calendar.count() == 44 and study.lab_sequence.count() == 2
    # the site counts taken before assembly equal those of the wide frame
    assert rows(study.site_counts) == rows(trends.partner_counts(study.wide))


def test_wide_frame_keeps_every_member(spark, day):
    study = published(spark, day)
    assert study.wide.count() == study.base_cohort.count() == 2
    assert study.wide.select(F.count_distinct("person_id")).first()[0] == 2
