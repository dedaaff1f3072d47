"""The wide one-row-per-person analysis frame and its exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.functions.expressions import flag, month_start
from cohortkit.operators.trends import partner_counts
from cohortkit.sources import lookups

BEFORE, POST = "_before_covid_indicator", "_post_covid_indicator"


def _present(stem: str, as_published: bool) -> Column:
    post = lookups.SCORE_POST_VALUES.get(stem, 1) if as_published else 1
    return (F.col(stem + BEFORE) == 1) | (F.col(stem + POST) == post)


def score_columns(components: Mapping = lookups.SCORE_COMPONENTS, age: str = "age",
                  as_published: bool = True) -> dict[str, Column]:
    """Points per component: age bands, then the first stem present in each list."""
    def ladder(steps):
        return reduce(lambda chain, step: chain.when(*step), steps, F).otherwise(0)

    points = {"CCI_age": ladder([(F.col(age) >= lo, p) for lo, p in lookups.SCORE_AGE_BANDS])}
    for name, stems in components.items():
        points[name] = ladder([(_present(stem, as_published), p) for stem, p in stems])
    return points


def weighted_score(facts: DataFrame, components: Mapping = lookups.SCORE_COMPONENTS,
                   age: str = "age", id: str = "person_id", total: str = "CCI",
                   as_published: bool = True) -> DataFrame:
    """Comorbidity points per component and their sum.

    The published rule tests one liver column for 3 where all others are tested
    for 1; ``as_published=False`` tests every column for 1.
    """
    points = score_columns(components, age, as_published)
    return (facts.select(id, *(c.alias(name) for name, c in points.items()))
            .withColumn(total, reduce(add, map(F.col, points))))


def analysis_cohort(cohort: DataFrame, parts: Sequence[DataFrame], regions: DataFrame,
                    id: str = "person_id", as_published: bool = True) -> DataFrame:
    """One wide row per cohort member.

    ``parts`` are the per-person results (one row per person, any of them may be
    missing a person): exposure day counts, pct_group, early_imv / early_ecmo,
    wbc, trauma_count, trauma_observation_count, late_exposure_count,
    long_imv_count, early_major_procedure_count, early_vasopressor_count and
    late_onset.  All joins use the person key, so each part is shuffled once.
    """
    joined = reduce(lambda left, part: left.join(part, id, "left"), parts, cohort)
    places = regions.select(F.col("prefix").alias("_prefix"), "division", "region")
    joined = joined.join(places, F.substring("postal_code", 1, 3) == F.col("_prefix"), "left")
    more = lambda c, n: flag(F.col(c) > n)
    days = [f"{kind}_days_to_day_{k}" for kind in ("parenteral", "any") for k in (4, 5, 6)]
    points = score_columns(as_published=as_published)
    present = lambda stem: flag((F.col(stem + BEFORE) == 1) | (F.col(stem + POST) == 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "data_partner_id", id, "age", "gender_concept_name", "race_ethnicity",
        *(F.coalesce(c, F.lit("Other/Missing")).alias(c) for c in ("division", "region")),
        "sdoh2", "wbc", F.coalesce("bmi_before", "bmi_post").alias("bmi"),
        present("OBESITY").alias("obesity"), present("TOBACCOSMOKER").alias("smoker"),
        *(c.alias(name) for name, c in points.items()),
        "index_start", month_start(F.col("index_start")).alias("reporting_period"),
        F.datediff("index_end", "index_start").alias("total_length_of_stay"),
        F.coalesce("pct_group", F.lit("not measured")).alias("pct_group"),
        zero("early_imv").alias("early_imv"), zero("early_ecmo").alias("early_ecmo"),
        F.col("died_in_hospital").alias("hospital_mortality"),
        *(zero(c).alias(c) for c in days),
        # the thresholds differ on purpose: 4 of days 0-5, but all 5 of days 0-4
        more("parenteral_days_to_day_5", 3).alias("outcome_iv_day5"),
        more("any_days_to_day_5", 3).alias("outcome_any_day5"),
        more("parenteral_days_to_day_4", 4).alias("outcome_iv_day4"),
        more("any_days_to_day_4", 4).alias("outcome_any_day4"),
        zero("trauma_count").alias("early_trauma_dx_count"),
        zero("trauma_observation_count").alias("early_trauma_obs_count"),
        flag((F.col("trauma_count") > 0) | (F.col("trauma_observation_count") > 0))
        .alias("early_trauma_flag"),
        more("late_exposure_count", 0).alias("late_antibiotic_exposure"),
        more("long_imv_count", 0).alias("long_imv"),
        more("early_major_procedure_count", 0).alias("early_major_procedure"),
        more("early_vasopressor_count", 0).alias("early_vasopressor_use"),
        flag(F.col("late_onset").isNotNull()).alias("late_cdad"))


def eligible(df: DataFrame, start: str, end: str, min_rows: int,
             site_counts: DataFrame | None = None, site: str = "data_partner_id",
             month: str = "reporting_period") -> DataFrame:
    """Rows in [start, end) from sites with more than ``min_rows`` rows in all periods.

    Pass ``site_counts`` taken from the base cohort to avoid counting the wide
    frame: assembly keeps one row per person, so the counts are the same.
    """
    counts = partner_counts(df, site) if site_counts is None else site_counts
    large = counts.where(F.col("record_count") > min_rows).select(site)
    return (df.where((F.col(month) >= F.lit(start).cast("date"))
                     & (F.col(month) < F.lit(end).cast("date")))
            .join(large, site, "left_semi"))


def _common(score: Sequence[str]) -> dict[str, Column]:
    gender = F.col("gender_concept_name")
    return {
        "age": F.col("age").cast("int"),
        "CCI": reduce(add, map(F.col, score)),
        "gender_concept_name": F.when(gender.isin("MALE", "FEMALE"), gender)
        .otherwise("UNKNOWN_OTHER"),
    }


SCORE_NAMES = ("CCI_age", *lookups.SCORE_COMPONENTS)


def apply_exclusions(wide: DataFrame, start: str = lookups.STUDY_START,
                     end: str = lookups.STUDY_END, min_rows: int = lookups.MIN_SITE_ROWS,
                     site_counts: DataFrame | None = None,
                     score: Sequence[str] = SCORE_NAMES) -> DataFrame:
    """The main analysis frame: eligible rows, score total, outcome columns."""
    common = _common(score)
    return eligible(wide, start, end, min_rows, site_counts).select(
        "data_partner_id", "person_id", common["age"].alias("age"), "race_ethnicity", "region",
        "division", "sdoh2", "bmi", "wbc", "obesity", "smoker", common["CCI"].alias("CCI"),
        common["gender_concept_name"].alias("gender_concept_name"), "reporting_period",
        "index_start", "total_length_of_stay", F.col("outcome_iv_day5").alias("target"),
        F.col("parenteral_days_to_day_5").cast("int").alias("exposure_days"),
        "outcome_iv_day4", "outcome_any_day4", "outcome_iv_day5", "outcome_any_day5",
        "pct_group", "early_imv", "early_ecmo", "hospital_mortality", "long_imv",
        "late_antibiotic_exposure", "late_cdad",
        F.col("early_trauma_dx_count").cast("int").alias("early_trauma_dx_count"),
        F.col("early_trauma_obs_count").cast("int").alias("early_trauma_obs_count"),
        "early_trauma_flag", "early_major_procedure", "early_vasopressor_use",
        flag((F.col("long_imv") == 1) | (F.col("hospital_mortality") == 1))
        .alias("primary_outcome"))


def sensitivity_frame(wide: DataFrame, start: str = lookups.STUDY_START,
                      end: str = lookups.SENSITIVITY_END, min_rows: int = lookups.MIN_SITE_ROWS,
                      site_counts: DataFrame | None = None,
                      score: Sequence[str] = SCORE_NAMES) -> DataFrame:
    """The frame for threshold sensitivity: an earlier end date and the six day counts."""
    common = _common(score)
    days = [f"{kind}_days_to_day_{k}" for kind in ("any", "parenteral") for k in (4, 5, 6)]
    return eligible(wide, start, end, min_rows, site_counts).select(
        "data_partner_id", "person_id", common["age"].alias("age"), "race_ethnicity", "sdoh2",
        "bmi", "wbc", "obesity", "smoker", common["CCI"].alias("CCI"),
        common["gender_concept_name"].alias("gender_concept_name"), "reporting_period",
        "total_length_of_stay", "pct_group", "early_imv", "early_vasopressor_use", "early_ecmo",
        *(F.col(d).cast("int").alias(d) for d in days))


def prefix_region(zips: DataFrame, states: DataFrame, n: int = 3, order: str = "asc",
                  code: str = "postal_code", state: str = "state") -> DataFrame:
    """One state per postal prefix, with its region.

    ``order='asc'`` takes the *least* common state (what the published tables
    rest on), 'desc' the most common; ties go to the first state by name.
    """
    if order not in ("asc", "desc"):
        raise ValueError("order is 'asc' or 'desc'")
    counts = (zips.groupBy(F.substring(code, 1, n).alias("prefix"), state)
              .agg(F.count(F.lit(1)).alias("_n")))
    weight = F.col("_n") if order == "asc" else -F.col("_n")
    chosen = counts.groupBy("prefix").agg(
        F.min(F.struct(weight.alias("w"), F.col(state).alias("s")))["s"].alias(state))
    return (chosen.join(states.select(state, "division", "region"), state, "left")
            .select("prefix", state, "division", "region"))
