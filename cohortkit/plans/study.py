"""The antibiotic-exposure study as one graph of lazy DataFrames.

Give the source tables and every derived dataset is a property.  Nothing runs
until a result is written or collected; ``keep`` may be ``session.checkpoint``
to materialise the datasets several others read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache, cached_property

from pyspark.sql import DataFrame, functions as F

from cohortkit.functions.expressions import flag, month_start
from cohortkit.operators import analysis, cohort, exposure, record, rules, timeline, trends
from cohortkit.sources import lookups

# Names in the published person-level fact table -> names used here.
FACT_COLUMNS = {
    "age_at_covid": "age",
    "first_COVID_hospitalization_start_date": "index_start",
    "first_COVID_hospitalization_end_date": "index_end",
    "COVID_first_PCR_or_AG_lab_positive": "first_positive",
    "COVID_first_diagnosis_date": "first_diagnosis",
    "COVID_first_poslab_or_diagnosis_date": "first_evidence",
    "COVID_associated_hospitalization_indicator": "hospitalized",
    "COVID_patient_death_during_covid_hospitalization_indicator": "died_in_hospital",
    "LL_ECMO_during_covid_hospitalization_indicator": "ecmo_in_stay",
    "LL_IMV_during_covid_hospitalization_indicator": "imv_in_stay",
    "REMDISIVIR_during_covid_hospitalization_indicator": "antiviral_in_stay",
    "COVIDREGIMENCORTICOSTEROIDS_during_covid_hospitalization_indicator": "steroid_in_stay",
    "BMI_max_observed_or_calculated_before_covid": "bmi_before",
    "BMI_max_observed_or_calculated_post_covid": "bmi_post",
}


# Names of the published tables, and the columns renamed in them.
TABLES = {
    "facts": ("covid_facts", FACT_COLUMNS),
    "drugs": ("drug_exposure", {}),
    "measurements": ("measurement", {"harmonized_value_as_number": "value"}),
    "conditions": ("condition_occurrence", {}),
    "procedures": ("procedure_occurrence", {}),
    "observations": ("observation", {}),
    "members": ("concept_set_members", {}),
    "concepts": ("concept", {}),
    "zips": ("zip_codes", {"admin_code1": "state"}),
    "injuries": ("Snomed_concepts_for_ccsr_injury_groups", {}),
    "major_procedures": ("Concepts_major_procedures", {}),
}


def published_sources(tables: Callable[[str], DataFrame]) -> Callable[[str], DataFrame]:
    """The study's inputs, by role, from tables in the published (OMOP-like) layout."""
    def source(role: str) -> DataFrame:
        name, renamed = TABLES[role]
        return tables(name).withColumnsRenamed(renamed)
    return source


@dataclass(frozen=True)
class StudyParams:
    """Vocabulary ids, windows and thresholds; defaults are the published ones."""

    antibiotics: int = lookups.ANTIBIOTIC_CODESET
    extended_spectrum: int = lookups.EXTENDED_SPECTRUM_CODESET
    vasopressors: int = lookups.VASOPRESSOR_CODESET
    ventilation_set: str = lookups.VENTILATION_SET_NAME
    ecmo_set: str = lookups.ECMO_SET_NAME
    late_infections: Sequence[int] = lookups.LATE_INFECTION_CONCEPTS
    rules: rules.RouteRules = field(default_factory=rules.RouteRules)
    labels: Sequence[str] = lookups.DRUG_LABELS
    drops: Sequence[str] = lookups.DROP_LABELS
    long_episode: int = 14
    lab_cut: float = 0.5
    start: str = lookups.STUDY_START
    end: str = lookups.STUDY_END
    sensitivity_end: str = lookups.SENSITIVITY_END
    min_site_rows: int = lookups.MIN_SITE_ROWS
    prefix_order: str = "asc"
    lab_tie: str = "measurement_id"


class Study:
    """Derived datasets of the study over its source tables."""

    def __init__(self, source: Callable[[str], DataFrame], lookup: Callable[[str], DataFrame],
                 params: StudyParams = StudyParams(),
                 keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        """``source`` gives the input of a role (see TABLES), ``lookup`` a literal table.

        ``lookup`` is usually ``functools.partial(lookup_table, spark)``.
        """
        self.p, self.keep = params, keep
        self.src, self.lookup = cache(source), cache(lookup)

    def _set(self, codeset: int) -> DataFrame:
        return cohort.concept_set(self.src("members"), codeset)

    @cached_property
    def base_cohort(self) -> DataFrame:
        return cohort.base_cohort(self.src("facts"))

    @cached_property
    def calendar(self) -> DataFrame:
        return cohort.index_calendar(self.base_cohort)

    @cached_property
    def exposures(self) -> DataFrame:
        return self.keep(exposure.exposure_days(self.src("drugs"), self.base_cohort,
                                                self._set(self.p.antibiotics)))

    @cached_property
    def vasopressors(self) -> DataFrame:
        return exposure.exposure_days(self.src("drugs"), self.base_cohort,
                                      self._set(self.p.vasopressors))

    @cached_property
    def rates(self) -> DataFrame:
        return rules.route_rates(self.exposures, self.lookup("routes"))

    @cached_property
    def routed(self) -> DataFrame:
        return rules.rule_cascade(self.exposures, self.lookup("routes"), self.rates, self.p.rules)

    @cached_property
    def by_day(self) -> DataFrame:
        return self.keep(exposure.exposures_by_day(self.routed))

    @cached_property
    def exposure_counts(self) -> DataFrame:
        return exposure.exposure_summary(self.by_day)

    @cached_property
    def drug_counts(self) -> DataFrame:
        return trends.concept_frequency(self.exposures, "drug_concept_id", "drug_concept_name",
                                        F.col("hospital_day") < 5, count="c")

    @cached_property
    def labelled_drugs(self) -> DataFrame:
        return rules.first_match_label(self.drug_counts, labels=self.p.labels, drops=self.p.drops)

    @cached_property
    def labelled_days(self) -> DataFrame:
        return rules.labelled_person_day(self.exposures, self.labelled_drugs)

    @cached_property
    def label_counts(self) -> DataFrame:
        return rules.label_counts_by_day(self.labelled_days)

    @cached_property
    def severity(self) -> DataFrame:
        members = self.src("members")
        return self.keep(timeline.severity_by_day(
            self.base_cohort,
            [(self.src("procedures"), "procedure_concept_id", "procedure_date"),
             (self.src("observations"), "observation_concept_id", "observation_date")],
            {"imv": cohort.concept_set(members, set_name=self.p.ventilation_set),
             "ecmo": cohort.concept_set(members, set_name=self.p.ecmo_set)}))

    @cached_property
    def labs(self) -> DataFrame:
        return self.keep(timeline.labs_in_stay(self.src("measurements"), self.lookup("labs"),
                                               self.base_cohort))

    @cached_property
    def lab_sequence(self) -> DataFrame:
        return timeline.lab_sequence(self.labs, tie=self.p.lab_tie)

    @cached_property
    def first_wbc(self) -> DataFrame:
        return timeline.first_value(self.labs, "wbc", tie=self.p.lab_tie)

    @cached_property
    def early_pct(self) -> DataFrame:
        return timeline.early_max_band(self.labs, "pct", self.p.lab_cut)

    @cached_property
    def early_conditions(self) -> DataFrame:
        return timeline.events_in_window(self.base_cohort, self.src("conditions"),
                                         "condition_start_date", -2, 7)

    @cached_property
    def late_conditions(self) -> DataFrame:
        return timeline.events_in_window(self.base_cohort, self.src("conditions"),
                                         "condition_start_date", 8, None)

    @cached_property
    def courses(self) -> DataFrame:
        return timeline.assign_courses(self.by_day)

    @cached_property
    def course_durations(self) -> DataFrame:
        return timeline.first_course_duration(self.courses)

    @cached_property
    def imv_episodes(self) -> DataFrame:
        return timeline.gap_episodes(self.severity.where(F.col("imv") > 0))

    def _count(self, source: str, concepts: DataFrame, concept: str, date: str, lo, hi, name: str,
               members: DataFrame | None = None, bounds: Sequence[str] = ()) -> DataFrame:
        return timeline.windowed_event_count(
            self.base_cohort if members is None else members, self.src(source), concepts,
            concept, date, lo, hi, name, bounds=bounds)

    @cached_property
    def parts(self) -> list[DataFrame]:
        """The eleven per-person results the wide frame is made of, each on its own."""
        p, src = self.p, self.src
        return [
            self.exposure_counts,
            self.early_pct,
            timeline.early_severity(self.severity),
            self.first_wbc,
            self._count("conditions", src("injuries"), "condition_concept_id",
                        "condition_start_date", -2, 7, "trauma_count"),
            self._count("observations", src("injuries"), "observation_concept_id",
                        "observation_date", 0, 7, "trauma_observation_count"),
            self._count("drugs", self._set(p.extended_spectrum), "drug_concept_id",
                        "drug_exposure_start_date", 8, F.col("index_end"),
                        "late_exposure_count", bounds=["index_end"]),
            timeline.long_episodes(self.imv_episodes, p.long_episode, name="long_imv_count"),
            # counted for every person with facts, hospitalised or not
            self._count("procedures", src("major_procedures"), "procedure_concept_id",
                        "procedure_date", 0, 2, "early_major_procedure_count", src("facts")),
            exposure.early_use_count(self.vasopressors, name="early_vasopressor_count"),
            timeline.first_onset(self.late_conditions, p.late_infections, "condition_concept_id",
                                 "condition_start_date", "late_onset"),
        ]

    @cached_property
    def record(self) -> DataFrame:
        """The same results in one pass: each event table is read once (drugs once more, for the
        route rates), and all listed events are shuffled once, by person."""
        p, src = self.p, self.src
        members = src("members")
        severity = {"imv": cohort.concept_set(members, set_name=p.ventilation_set),
                    "ecmo": cohort.concept_set(members, set_name=p.ecmo_set)}
        events = [
            record.drug_events(src("drugs"), self._set(p.antibiotics), self._set(p.extended_spectrum),
                               self._set(p.vasopressors), self.lookup("routes"), self.rates, p.rules),
            record.condition_events(src("conditions"), src("injuries"), p.late_infections),
            record.coded_events(src("procedures"), "procedure_concept_id", "procedure_date",
                                {**severity, "procedure": src("major_procedures")}),
            record.coded_events(src("observations"), "observation_concept_id", "observation_date",
                                {**severity, "trauma_observation": src("injuries")}),
            record.lab_events(src("measurements"), self.lookup("labs"), tie=p.lab_tie),
        ]
        return record.person_record(events, self.base_cohort, p.lab_cut, p.long_episode)

    @cached_property
    def regions(self) -> DataFrame:
        return analysis.prefix_region(self.src("zips"), self.lookup("states"),
                                      order=self.p.prefix_order)

    @cached_property
    def wide(self) -> DataFrame:
        return self.keep(analysis.analysis_cohort(self.base_cohort, [self.record], self.regions))

    @cached_property
    def site_counts(self) -> DataFrame:
        # every join above is a left join on a unique key, so base rows = wide rows
        return trends.partner_counts(self.base_cohort)

    @cached_property
    def main(self) -> DataFrame:
        p = self.p
        return self.keep(analysis.apply_exclusions(self.wide, p.start, p.end, p.min_site_rows,
                                                   self.site_counts))

    @cached_property
    def sensitivity(self) -> DataFrame:
        p = self.p
        return analysis.sensitivity_frame(self.wide, p.start, p.sensitivity_end, p.min_site_rows,
                                          self.site_counts)

    @cached_property
    def course_for_cohort(self) -> DataFrame:
        p = self.p
        # the outcome and the exclusions of the wide frame need only the exposure counts
        stays = self.base_cohort.join(self.exposure_counts, "person_id", "left").select(
            "person_id", "data_partner_id", month_start(F.col("index_start")).alias("reporting_period"),
            flag(F.col("parenteral_days_to_day_4") > 4).alias("outcome_iv_day4"))
        members = analysis.eligible(stays, p.start, p.end, p.min_site_rows, self.site_counts)
        return timeline.course_for_cohort(self.course_durations, members, ["outcome_iv_day4"])
