"""Every operator bound to the test tables, by name.

Each entry takes (spark, folder) and returns a DataFrame over whole tables.
Doubles are rounded so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortkit.functions.expressions import flag, logistic, month_index
from cohortkit.operators import (analysis, checks, cohort, exposure, gam, impute, matching,
                                 regression, rules, summary, timeline, trends, weighting)
from cohortkit.plans import effects
from cohortkit.plans.study import Study, StudyParams
from cohortkit.session import checkpoint, tune
from cohortkit.sources import lenses, sink
from cohortkit.sources.lookups import lookup_table
from cohortkit.sources.tables import parquet_tables

Query = Callable[[SparkSession, str], DataFrame]

LATE_INFECTIONS = tuple(range(20, 26))
PARAMS = StudyParams(
    antibiotics=lenses.CODESETS["antibiotic"], extended_spectrum=lenses.CODESETS["extended"],
    vasopressors=lenses.CODESETS["vasopressor"], ventilation_set="imv", ecmo_set="ecmo",
    late_infections=LATE_INFECTIONS, rules=lenses.RULES, labels=lenses.LABELS,
    drops=lenses.DROPS, long_episode=3, lab_cut=60.0, start="2024-01-01", end="2024-02-01",
    sensitivity_end="2024-01-02", min_site_rows=3)
ORIGIN = (1995, 1)
FLAGS = ("early_imv", "early_ecmo", "early_trauma_flag", "early_major_procedure",
         "early_vasopressor_use")
OUTCOMES = effects.OUTCOMES


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c)
                       for c, kind in df.dtypes))


def timeline_study(spark: SparkSession, folder: str, stored_facts: bool = False,
                   params: StudyParams = PARAMS,
                   keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Study:
    """The study over the timeline lens.

    ``stored_facts`` writes the person table once, for results that join it many
    times: the study expects it as a stored table, not as a query.
    """
    lens = lenses.Timeline(parquet_tables(tune(spark), folder))
    roles = {"members": lens.concept_set_members}
    own = {"labs": lens.labs, "states": lens.states}

    def source(role: str) -> DataFrame:
        df = roles.get(role, getattr(lens, role, None))()
        return checkpoint(df) if role == "facts" and stored_facts else df

    def lookup(name: str) -> DataFrame:
        return own[name]() if name in own else lookup_table(spark, name)

    return Study(source, lookup, params, keep)


def encounter_rows(spark: SparkSession, folder: str) -> DataFrame:
    return lenses.encounters(parquet_tables(tune(spark), folder))


def _study(build: Callable[[Study], DataFrame]) -> Query:
    return lambda spark, folder: neat(build(timeline_study(spark, folder)))


def _whole_study(build: Callable[[Study], DataFrame]) -> Query:
    return lambda spark, folder: neat(build(timeline_study(spark, folder, stored_facts=True)))


def _stored_study(build: Callable[[Study], DataFrame]) -> Query:
    return lambda spark, folder: neat(build(timeline_study(
        spark, folder, stored_facts=True, keep=sink.bucketed_keep(buckets=16))))


def _stays(build: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, folder: neat(build(encounter_rows(spark, folder)), digits)


# --- timeline lens ---------------------------------------------------------

def _early_rates(s: Study) -> DataFrame:
    return trends.condition_rates(
        s.early_conditions, s.base_cohort, s.src("concepts"),
        {"ecmo_rate": "ecmo_in_stay", "imv_rate": "imv_in_stay",
         "antiviral_rate": "antiviral_in_stay", "steroid_rate": "steroid_in_stay"})


def _window_check(s: Study) -> DataFrame:
    return checks.check_window(s.base_cohort).select(
        "person_id", "first_diagnosis", "first_positive", "index_start", "index_end")


LAB_COLUMNS = ("person_id", "measurement_id", "measure_name", "value", "measurement_date",
               "hospital_day", "seq_no")

TIMELINE: dict[str, Query] = {
    "base_cohort": _study(lambda s: s.base_cohort.select(
        "person_id", "data_partner_id", "age", "gender_concept_name", "race_ethnicity",
        "postal_code", "sdoh2", "index_start", "index_end", "first_positive", "bmi_before",
        "bmi_post", "died_in_hospital")),
    "index_calendar": _study(lambda s: s.calendar),
    "concept_set": _study(lambda s: cohort.concept_set(s.src("members"), PARAMS.antibiotics)),
    "concept_set_by_name": _study(lambda s: cohort.concept_set(
        s.src("members"), set_name="imv", latest=False)),
    "exposure_days": _study(lambda s: s.exposures),
    "vasopressor_days": _study(lambda s: s.vasopressors),
    "exposures_by_day": _study(lambda s: s.by_day),
    "exposure_summary": _study(lambda s: s.exposure_counts),
    "early_use_count": _study(lambda s: exposure.early_use_count(s.vasopressors)),
    "route_rates": _study(lambda s: s.rates),
    "rule_cascade": _study(lambda s: s.routed),
    "unmapped_frequency": _study(lambda s: rules.unmapped_frequency(s.routed)),
    "route_rates_named": _study(lambda s: rules.route_rates_named(s.rates, s.src("concepts"))),
    "concept_frequency": _study(lambda s: s.drug_counts),
    "condition_frequency": _study(lambda s: trends.concept_frequency(
        s.early_conditions, "condition_concept_id", "condition_concept_name", pick="min")),
    "first_match_label": _study(lambda s: s.labelled_drugs),
    "labelled_person_day": _study(lambda s: s.labelled_days),
    "label_counts_by_day": _study(lambda s: s.label_counts),
    "top_n_lump": _study(lambda s: trends.top_n_lump(s.label_counts, 3)),
    "severity_by_day": _study(lambda s: s.severity),
    "early_severity": _study(lambda s: timeline.early_severity(s.severity)),
    "lab_sequence": _study(lambda s: s.lab_sequence.select(*LAB_COLUMNS)),
    "first_value": _study(lambda s: s.first_wbc),
    "early_max_band": _study(lambda s: s.early_pct),
    "events_in_window": _study(lambda s: s.early_conditions),
    "late_events": _study(lambda s: s.late_conditions),
    "windowed_event_count": _study(lambda s: s.parts[4]),
    "trauma_observation_count": _study(lambda s: s.parts[5]),
    "late_exposure_count": _study(lambda s: s.parts[6]),
    "major_procedure_count": _study(lambda s: s.parts[8]),
    "first_onset": _study(lambda s: s.parts[10]),
    "first_onset_by_set": _study(lambda s: timeline.first_onset(
        s.late_conditions, s.src("late_infections"), "condition_concept_id",
        "condition_start_date")),
    "assign_courses": _study(lambda s: s.courses),
    "first_course_duration": _study(lambda s: s.course_durations),
    "course_for_cohort": _whole_study(lambda s: s.course_for_cohort),
    "course_quantiles": _whole_study(lambda s: timeline.course_quantiles(
        s.course_for_cohort, ["outcome_iv_day4"])),
    "course_quantiles_overall": _whole_study(lambda s: timeline.course_quantiles(
        s.course_for_cohort, probs=(0, 0.25, 0.5, 0.75, 1))),
    "gap_episodes": _study(lambda s: s.imv_episodes),
    "long_episodes": _study(lambda s: timeline.long_episodes(s.imv_episodes, 3)),
    "weighted_score": _study(lambda s: analysis.weighted_score(s.base_cohort)),
    "analysis_cohort": _whole_study(lambda s: s.wide),
    "apply_exclusions": _whole_study(lambda s: s.main),
    "stored_exclusions": _stored_study(lambda s: s.main),
    "sensitivity_frame": _whole_study(lambda s: s.sensitivity),
    "prefix_region": _study(lambda s: s.regions),
    "condition_rates": _study(_early_rates),
    "check_window": _study(_window_check),
    "check_unique": _study(lambda s: checks.check_unique(s.base_cohort)),
    "check_rule_coverage": _study(lambda s: checks.check_rule_coverage(s.routed)),
    "spot_check": _study(lambda s: checks.spot_check(s.routed, "drug_concept_name", "red gizmo")),
}

# --- encounter lens --------------------------------------------------------

GAM_COLUMNS = {"linear": FLAGS, "factors": ["gender_concept_name"], "smooth": ["age", "CCI"],
               "random": ["month", "data_partner_id"]}


def _month_frame(e: DataFrame) -> DataFrame:
    counts = trends.month_covariates(e, {
        "early_imv_count": "early_imv", "early_ecmo_count": "early_ecmo",
        "early_trauma_dx_count": "early_trauma_flag",
        "early_major_procedure_count": "early_major_procedure",
        "early_vasopressor_use_count": "early_vasopressor_use", "target_count": "target"})
    return counts.withColumn("t", month_index(F.col("reporting_period"), ORIGIN))


def _month_rates(e: DataFrame) -> DataFrame:
    frame = _month_frame(e)
    counts = [c for c in frame.columns if c.endswith("_count") and c != "encounter_count"]
    return frame.select("t", *((F.col(c) / F.col("encounter_count")).alias(c.removesuffix("_count"))
                               for c in counts))


def _true_link(e: DataFrame) -> DataFrame:
    """The logit of the probability the outcome was built from: a known score."""
    p = 0.2 + 0.1 * F.least(F.col("CCI"), F.lit(6))
    return e.withColumn("link", F.log(p / (1 - p)))


def _any_route(e: DataFrame) -> DataFrame:
    """Exposure by any route: more than 3 of the first 6 days."""
    return e.withColumn("target", flag(F.col("any_days_to_day_5") > 3))


def _weighted(e: DataFrame) -> DataFrame:
    return weighting.iptw(_true_link(e), "link", cap=4.0)


def _by_covariate(e: DataFrame) -> DataFrame:
    return trends.conditional_means(e, {
        **{c: c for c in FLAGS},
        "pct_high": F.when(F.col("pct_group") == "high", 1).otherwise(0),
        "pct_low": F.when(F.col("pct_group") == "low", 1).otherwise(0)})


def _pooled(e: DataFrame) -> DataFrame:
    """Pool the same effect estimated in each region, as if regions were imputations."""
    est = regression.odds_ratio(e, OUTCOMES, "target", by=["region"])
    return regression.rubin_pool(est)


def _gam(e: DataFrame) -> tuple[DataFrame, gam.GamFit]:
    rows = effects.model_frame(e, ORIGIN)
    return rows, effects.exposure_model(rows)


def _gam_terms(e: DataFrame) -> DataFrame:
    _, fit = _gam(e)
    spark = e.sparkSession
    return fit.terms(spark).join(fit.smooth_terms(spark).withColumnRenamed("term", "block"),
                                 F.substring_index("term", ").", 1) == F.expr(
                                     "substring_index(block, ')', 1)"), "left")


def _region_model(e: DataFrame) -> DataFrame:
    fit = effects.exposure_model(effects.model_frame(e, ORIGIN), extra_random=["region"])
    return fit.smooth_terms(e.sparkSession)


def _pct_model(e: DataFrame) -> DataFrame:
    rows = effects.model_frame(e.where(F.col("pct_group") != "not measured"), ORIGIN)
    return effects.exposure_model(rows, extra_factors=["pct_group"],
                                  reference={"pct_group": "low"}).terms(e.sparkSession)


def _gam_link(e: DataFrame) -> DataFrame:
    rows, fit = _gam(e)
    return fit.predict(rows).select("person_id", "target", "link")


def _gam_calibration(e: DataFrame) -> DataFrame:
    rows, fit = _gam(e)
    scored = checkpoint(fit.predict(rows).withColumn("pred", 1 / (1 + F.exp(-F.col("link")))))
    return trends.calibration_bins(scored, "pred")


def _gam_margins(e: DataFrame) -> DataFrame:
    """Events that the exposure model fits, in all rows and per flag and gender: those observed, for
    terms without a penalty."""
    rows, fit = _gam(e)
    flags = [F.when(F.col(c) == 1, c) for c in effects.EARLY]
    scored = fit.predict(rows).where(F.col("link").isNotNull()).select(
        F.explode(F.array_compact(F.array(F.lit("all"), F.col("gender_concept_name"), *flags))).alias("term"),
        logistic(F.col("link")).alias("p"))
    return scored.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 1).alias("events"))


def _match(e: DataFrame) -> DataFrame:
    scored = _true_link(e).withColumn("score", F.col("link") + F.col("age") / 1000
                                      + F.col("sdoh2") / 10000)
    return matching.propensity_match(
        scored.select("person_id", "target", "score", "CCI", *OUTCOMES), "score",
        caliper=0.2, exact=["CCI"])


def _match_summary(e: DataFrame) -> DataFrame:
    """Per stratum: matched units of each arm, the lowest treated score among them, pairs beyond the caliper."""
    matched = _match(e)
    pairs = matched.groupBy("CCI", "subclass").agg(
        F.max(F.when(F.col("target") == 1, F.col("distance"))).alias("t"),
        F.max(F.when(F.col("target") == 0, F.col("distance"))).alias("c"),
        F.count_if(F.col("target") == 1).alias("n_t"), F.count_if(F.col("target") == 0).alias("n_c"))
    return pairs.groupBy("CCI").agg(
        F.sum("n_t").alias("n_treated"), F.sum("n_c").alias("n_controls"), F.min("t").alias("lowest_treated"),
        F.count_if(F.coalesce(F.abs(F.col("t") - F.col("c")) > 0.2, F.lit(True))).alias("beyond_caliper"))


def _imputed(e: DataFrame) -> DataFrame:
    return impute.impute_chained(
        e, ["bmi", "wbc"], predictors=["age", "CCI", "target", *FLAGS, "hospital_mortality"],
        factors=["race_ethnicity"])


COMPLETE = ("person_id", "target", "reporting_period", *FLAGS, "race_ethnicity", "age",
            "hospital_mortality", "CCI", "bmi", "wbc")

ENCOUNTERS: dict[str, Query] = {
    "partner_counts": _stays(trends.partner_counts),
    "center_month": _stays(trends.center_month),
    "division_month": _stays(lambda e: trends.center_month(e, "division")
                             .drop("exposure_count")),
    "month_stats": _stays(trends.month_stats),
    "month_covariates": _stays(lambda e: _month_frame(e).drop("t")),
    "overall_rates": _stays(lambda e: trends.overall_rates(
        e, ["target", "long_imv", "early_ecmo", "early_imv", "early_vasopressor_use"])),
    "check_partner_threshold": _stays(lambda e: checks.check_partner_threshold(
        trends.partner_counts(e))),
    "strata_month_rate": _stays(lambda e: trends.strata_month_rate(e, [*FLAGS, "pct_group"])),
    "month_rate_overall": _stays(lambda e: trends.month_prevalence(e, {"avg": "target"})),
    "month_prevalence": _stays(lambda e: trends.month_prevalence(e, {
        "early_ecmo": "early_ecmo", "early_imv": "early_imv", "early_trauma": "early_trauma_flag",
        "early_surgery": "early_major_procedure",
        "late_antibiotic_exposure": "late_antibiotic_exposure", "long_imv": "long_imv"})),
    "outcome_ratio": _stays(lambda e: trends.outcome_ratio(
        e, ["late_antibiotic_exposure", "long_imv", "hospital_mortality", "late_cdad"])),
    "trends_long": _stays(lambda e: trends.trends_long(e, {
        "early_ecmo": "ECMO", "early_imv": "IMV", "early_trauma_flag": "Trauma",
        "early_major_procedure": "Surgery", "early_vasopressor_use": "Vasopressor Use"})),
    "box_summary": _stays(lambda e: trends.box_summary(trends.center_month(e))),
    "center_vs_overall": _stays(lambda e: trends.center_vs_overall(
        trends.center_month(e), trends.month_stats(e))),
    "los_summary": _stays(lambda e: trends.los_summary(e, F.col("hospital_mortality") == 1)),
    "conditional_means": _stays(_by_covariate),
    "crosstab": _stays(lambda e: trends.crosstab(e, "pct_group", "target", [0, 1])
                       .withColumnsRenamed({"0": "n_0", "1": "n_1"})),
    "threshold_grid": _stays(lambda e: trends.threshold_grid(
        e, {f"{kind}_days_to_day_{k}": k for kind in ("any", "parenteral") for k in (4, 5, 6)})),
    "calibration_bins": _stays(lambda e: trends.calibration_bins(
        e.withColumn("score", F.col("sdoh2") / 100 + F.col("CCI") / 10), "score")),
    "ols_trend": _stays(lambda e: regression.ols_trend(_month_rates(e), "t", "target")),
    "ols_trend_late": _stays(lambda e: regression.ols_trend(
        _month_rates(e).where(F.col("t") > 40), "t", "target")),
    "segmented_ols": _stays(lambda e: regression.segmented_ols(
        _month_rates(e), "t", ["early_imv", "early_ecmo", "early_trauma_dx",
                               "early_major_procedure", "early_vasopressor_use"], 40)),
    "segmented_ols_by_covariate": _stays(lambda e: regression.segmented_ols(
        _by_covariate(e).withColumn("t", month_index(F.col("reporting_period"), ORIGIN)), "t",
        [*FLAGS, "pct_high", "pct_low"], 40)),
    "poisson_trend": _stays(lambda e: regression.poisson_trend(
        _month_frame(e), "t", "target_count", "encounter_count").drop("p")
        .withColumn("statistic", F.round("statistic", 4))),
    "poisson_trend_late": _stays(lambda e: regression.poisson_trend(
        _month_frame(e).where(F.col("t") > 40), "t", "target_count", "encounter_count").drop("p")
        .withColumn("statistic", F.round("statistic", 4))),
    "grouped_logit": _stays(lambda e: regression.grouped_logit(
        trends.center_month(e).withColumn("t", month_index(F.col("reporting_period"), ORIGIN)),
        "t", "exposure_count", "case_count").drop("p")
        .withColumn("statistic", F.round("statistic", 4))),
    "odds_ratio": _stays(lambda e: regression.odds_ratio(e, OUTCOMES, "target")),
    "odds_ratio_any_route": _stays(lambda e: regression.odds_ratio(_any_route(e), OUTCOMES, "target")),
    "balance_any_route": _stays(lambda e: weighting.balance_table(
        _any_route(e), "target", ["age", "CCI", "bmi", "wbc"], [*FLAGS, "race_ethnicity"])),
    "odds_ratio_profile": _stays(lambda e: regression.odds_ratio(
        e, OUTCOMES, "target", by=["region"], interval="profile")),
    "odds_ratio_weighted": _stays(lambda e: regression.odds_ratio(
        _weighted(e), OUTCOMES[:3], "target", "weight")),
    "rubin_pool": _stays(_pooled, 4),
    "iptw": _stays(lambda e: _weighted(e).select("person_id", "target", "pred", "weight")),
    "weight_histogram": _stays(lambda e: weighting.weight_histogram(_weighted(e))),
    "balance_table": _stays(lambda e: weighting.balance_table(
        e, "target", ["age", "CCI", "bmi", "wbc"], [*FLAGS, "race_ethnicity"])),
    "balance_table_weighted": _stays(lambda e: weighting.balance_table(
        _weighted(e), "target", ["age", "CCI"], ["gender_concept_name"], "weight")),
    "table1_continuous": _stays(lambda e: summary.table1_continuous(
        e, "target", ["age", "total_length_of_stay", "bmi", "sdoh2", "CCI", "wbc"])),
    "table1_categorical": _stays(lambda e: summary.table1_categorical(
        e.withColumn("gender_concept_name",
                     F.nullif(F.col("gender_concept_name"), F.lit("UNKNOWN_OTHER"))), "target",
        ["gender_concept_name", "race_ethnicity", "pct_group", "obesity", "smoker", *FLAGS,
         *OUTCOMES])),
    "summary_table": _stays(lambda e: summary.summary_table(
        e.withColumn("gender_concept_name",
                     F.nullif(F.col("gender_concept_name"), F.lit("UNKNOWN_OTHER"))), "target",
        ["age", "total_length_of_stay", "bmi", "sdoh2", "CCI", "wbc"], ["obesity", "smoker", *FLAGS, *OUTCOMES],
        ["gender_concept_name", "race_ethnicity", "pct_group"])),
    "rank_sum": _stays(lambda e: summary.rank_sum(
        e, "target", ["age", "bmi", "wbc", "total_length_of_stay"]), 4),
    "chi_square": _stays(lambda e: summary.chi_square(
        e, "target", ["race_ethnicity", "pct_group", "obesity", *OUTCOMES])),
    "exact_2x2": _stays(lambda e: summary.exact_2x2(
        e, "target", [*OUTCOMES, *FLAGS], ["data_partner_id", "reporting_period"])),
    "extreme_months_chisq": _stays(lambda e: summary.extreme_months_chisq(trends.month_stats(e))),
    "impute_mean": _stays(lambda e: impute.impute_mean(e, ["bmi", "wbc"])
                          .select("person_id", "bmi", "wbc"), 4),
    "complete_cases": _stays(lambda e: matching.complete_cases(e, COMPLETE)),
    # iterative or order-dependent: checked against brute force in the tests
    "gam_logit": _stays(_gam_terms),
    "gam_link": _stays(_gam_link),
    "gam_calibration": _stays(_gam_calibration),
    "gam_margins": _stays(_gam_margins),
    "gam_region_effect": _stays(_region_model),
    "gam_measured_group": _stays(_pct_model),
    "propensity_match": _stays(_match),
    "match_summary": _stays(_match_summary),
    "any_route_imputed_effects": _stays(lambda e: effects.imputed_matched_effects(
        effects.model_frame(_any_route(e), ORIGIN), "mean")[0]),
    "any_route_imputed_balance": _stays(lambda e: effects.imputed_matched_effects(
        effects.model_frame(_any_route(e), ORIGIN), "mean")[1]),
    "matched_effects": _stays(lambda e: effects.matched_effects(effects.model_frame(e, ORIGIN))),
    "weighted_effects": _stays(lambda e: effects.weighted_effects(effects.model_frame(e, ORIGIN))),
    "impute_chained": _stays(_imputed),
    "mean_imputed_effects": _stays(lambda e: effects.imputed_matched_effects(
        effects.model_frame(e, ORIGIN), "mean")[0]),
    "chained_imputed_effects": _stays(lambda e: effects.imputed_matched_effects(
        effects.model_frame(e, ORIGIN), "chained")[0]),
}


def _lookup_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Exposure days per recorded route, through the route table itself."""
    s = timeline_study(spark, folder)
    return (s.exposures.join(lookup_table(spark, "routes")
                             .withColumnRenamed("concept_id", "route_concept_id"),
                             "route_concept_id")
            .groupBy("route_concept_id", "concept_name", "is_parenteral", "is_enteral",
                     "is_missing").agg(F.count(F.lit(1)).alias("n")))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The main analysis frame, end to end, without a lower limit on site size."""
    params = replace(PARAMS, min_site_rows=0)
    return neat(timeline_study(spark, folder, stored_facts=True, params=params).main)


def all_queries() -> dict[str, Query]:
    return {**TIMELINE, "lookup_tables": _lookup_rows, **ENCOUNTERS}
