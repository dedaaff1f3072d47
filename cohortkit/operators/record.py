"""All event tables in one pass: listed events of every role, reduced per person to the wide frame's columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.functions.expressions import flag, within_days
from cohortkit.operators.rules import RouteRules, rule_cascade
from cohortkit.sources.lookups import HORIZON_DAYS


def concept_flags(sets: Mapping[str, DataFrame]) -> DataFrame:
    """One row per concept of any of the sets: how often each set lists it."""
    rows = reduce(DataFrame.unionByName, [
        df.select("concept_id", F.lit(name).alias("_set")) for name, df in sets.items()])
    return rows.groupBy("concept_id").agg(*(
        F.count_if(F.col("_set") == name).alias(name) for name in sets))


def _listed(events: DataFrame, concept: str, sets: Mapping[str, DataFrame]) -> DataFrame:
    return events.join(concept_flags(sets).withColumnRenamed("concept_id", concept), concept)


def drug_events(drugs: DataFrame, antibiotics: DataFrame, extended: DataFrame,
                vasopressors: DataFrame, routes: DataFrame, rates: DataFrame,
                rules: RouteRules = RouteRules(), id: str = "person_id",
                start: str = "drug_exposure_start_date",
                end: str = "drug_exposure_end_date") -> DataFrame:
    """Exposures of the three sets as intervals, antibiotics with their decided routes.

    A route depends on the exposure and not on its day, so it is decided before any day is laid out.
    Expects one row per concept in ``routes``.
    """
    listed = _listed(drugs, "drug_concept_id", {
        "antibiotic": antibiotics, "extended": extended, "vasopressor": vasopressors})
    routed = rule_cascade(listed, routes, rates, rules, keep=[
        id, start, end, "antibiotic", "extended", "vasopressor"])
    taken = F.col("antibiotic") > 0
    return routed.select(
        id, F.col(start).alias("date"), F.coalesce(end, start).alias("last"),
        (taken & F.col("is_parenteral")).alias("parenteral"),
        (taken & (F.col("is_parenteral") | F.col("is_enteral"))).alias("any"),
        "extended", "vasopressor")


def condition_events(conditions: DataFrame, injuries: DataFrame, late: Sequence[int],
                     id: str = "person_id", concept: str = "condition_concept_id",
                     date: str = "condition_start_date") -> DataFrame:
    """Conditions listed as injuries or as late infections."""
    times = concept_flags({"trauma": injuries}).withColumnRenamed("concept_id", concept)
    is_late = F.col(concept).isin(list(late)) if late else F.lit(False)
    return (conditions.join(times, concept, "left").where(F.col("trauma").isNotNull() | is_late)
            .select(id, F.col(date).alias("date"), "trauma", is_late.alias("late")))


def coded_events(events: DataFrame, concept: str, date: str, sets: Mapping[str, DataFrame],
                 id: str = "person_id") -> DataFrame:
    """Events of the sets, with a count per set."""
    return _listed(events, concept, sets).select(id, F.col(date).alias("date"), *sets)


def lab_events(measurements: DataFrame, lookup: DataFrame, id: str = "person_id",
               concept: str = "measurement_concept_id", value: str = "value",
               date: str = "measurement_date", at: str = "measurement_datetime",
               tie: str = "measurement_id") -> DataFrame:
    """Known results of the listed measures."""
    measure = F.col("measure_name")
    return (measurements.where(F.col(value).isNotNull())
            .join(lookup.select(F.col("concept_id").alias(concept), "measure_name"), concept)
            .select(id, F.col(date).alias("date"), F.when(measure == "pct", F.col(value)).alias("pct"),
                    F.when(measure == "wbc", F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"),
                                                      F.col(value).alias("value"))).alias("wbc")))


def _bits(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def long_runs(days: Column, min_len: int, max_gap: int) -> Column:
    """How many runs of at least ``min_len`` of the array's days, steps of ``max_gap`` allowed."""
    def step(acc: Column, day: Column) -> Column:
        length = F.when(day - acc["day"] <= max_gap, acc["length"] + 1).otherwise(F.lit(1))
        return F.struct(day.alias("day"), length.alias("length"),
                        (acc["runs"] + flag(length == min_len)).alias("runs"))

    first = F.struct(F.lit(None).cast("int").alias("day"), F.lit(0).alias("length"), F.lit(0).alias("runs"))
    return F.aggregate(F.sort_array(days), first, step, lambda acc: acc["runs"])


def person_record(events: Sequence[DataFrame], cohort: DataFrame, lab_cut: float = 0.5,
                  long_episode: int = 14, cutoffs: Sequence[int] = (4, 5, 6), early: int = 2,
                  max_gap: int = 2, horizon: int = HORIZON_DAYS, id: str = "person_id",
                  index: str = "index_start", end: str = "index_end") -> DataFrame:
    """One row per cohort member with a listed event: what ``analysis_cohort`` reads of its parts.

    ``events`` are the roles' listed events.  Their union meets the cohort once, in one exchange by
    person that the grouping uses too; a hot person is split there and its partial results are
    merged.  Nothing grows with a person's events: exposed days are bits of a mask (they end at the
    last cutoff, up to 62), counts are sums, and the only list is of days of the stay.
    Counts are 0 or NULL where nothing falls in a window; the frame reads both alike.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)
    stay = cohort.select(id, F.col(index).alias("_index"), F.col(end).alias("_end"))
    joined = rows.join(stay, id)
    date, start = F.col("date"), F.col("_index")
    day = F.datediff(date, start)
    in_stay = date.between(start, F.col("_end"))
    lo = F.datediff(F.greatest(date, start), start)
    hi = F.datediff(F.least("last", F.date_add(start, horizon)), start)
    until = F.least(hi, F.lit(max(cutoffs)))
    mask = F.when(until >= lo, _bits(until + 1) - _bits(lo))
    early_days = F.greatest(F.least(hi, F.lit(early - 1)) - lo + 1, F.lit(0))
    counted = lambda name, lo, hi: F.sum(F.when(within_days(date, start, lo, hi), F.col(name)))
    early_flag = lambda name: F.max(F.when(in_stay & (day < early), flag(F.col(name) > 0)))
    kinds = ("parenteral", "any")
    per = joined.groupBy(id).agg(
        *(F.coalesce(F.bit_or(F.when(F.col(kind), mask)), F.lit(0)).alias(f"_{kind}") for kind in kinds),
        F.sum(F.col("vasopressor") * early_days).alias("early_vasopressor_count"),
        counted("extended", 8, F.col("_end")).alias("late_exposure_count"),
        counted("trauma", -2, 7).alias("trauma_count"),
        counted("trauma_observation", 0, 7).alias("trauma_observation_count"),
        counted("procedure", 0, 2).alias("early_major_procedure_count"),
        F.min(F.when(F.col("late") & within_days(date, start, 8, None), date)).alias("late_onset"),
        early_flag("imv").alias("early_imv"), early_flag("ecmo").alias("early_ecmo"),
        F.collect_set(F.when(in_stay & (F.col("imv") > 0), day)).alias("_imv_days"),
        F.max(F.when(in_stay & (day < early), F.col("pct"))).alias("_pct"),
        F.min(F.when(in_stay, F.col("wbc")))["value"].alias("wbc"))
    days = [F.bit_count(F.col(f"_{kind}").bitwiseAND(F.lit(2 ** (k + 1) - 1))).cast("long")
            .alias(f"{kind}_days_to_day_{k}") for kind in kinds for k in cutoffs]
    return per.select(
        id, *days, "early_vasopressor_count", "late_exposure_count", "trauma_count",
        "trauma_observation_count", "early_major_procedure_count", "late_onset", "early_imv", "early_ecmo",
        long_runs(F.col("_imv_days"), long_episode, max_gap).cast("long").alias("long_imv_count"),
        F.when(F.col("_pct") > lab_cut, "high").when(F.col("_pct").isNotNull(), "low").alias("pct_group"),
        "wbc")
