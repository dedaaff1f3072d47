"""From exposure intervals to exposure days and day counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.functions.expressions import flag
from cohortkit.sources.lookups import HORIZON_DAYS


def exposure_days(events: DataFrame, cohort: DataFrame, concepts: DataFrame,
                  start: str = "drug_exposure_start_date", end: str = "drug_exposure_end_date",
                  id: str = "person_id", concept: str = "drug_concept_id",
                  index: str = "index_start", horizon: int = HORIZON_DAYS) -> DataFrame:
    """One row per exposure and day it covers, within day 0..horizon.

    An exposure without an end counts on its start date only; one that ends
    before it starts never counts.  Overlapping exposures keep a row each.

    The interval meets the *cohort* (one row per person), not the calendar: the
    overlap is cut to the horizon and only then expanded, so the join never
    carries the 22 calendar rows per person.
    """
    listed = events.join(concepts.select(F.col("concept_id").alias(concept)), concept)
    members = cohort.select(id, F.col(index).alias("_index"))
    first = F.greatest(F.col(start), F.col("_index"))
    last = F.least(F.coalesce(end, start), F.date_add("_index", horizon))
    covered = listed.join(members, id).where(last >= first)
    return covered.select(
        *events.columns,
        F.explode(F.sequence(F.datediff(first, "_index"), F.datediff(last, "_index")))
        .alias("hospital_day"))


def exposures_by_day(routed: DataFrame, flags: Mapping[str, str | Column] | None = None,
                     id: str = "person_id", day: str = "hospital_day") -> DataFrame:
    """Per person and day, 1 if any exposure that day has the flag, else 0.

    ``flags`` maps output name to a boolean column.
    """
    flags = flags or {"enteral_exposure": "is_enteral", "parenteral_exposure": "is_parenteral"}
    return routed.groupBy(id, day).agg(*(
        F.max(flag(F.col(c) if isinstance(c, str) else c)).alias(name)
        for name, c in flags.items()))


def exposure_summary(by_day: DataFrame, cutoffs: Sequence[int] = (4, 5, 6),
                     id: str = "person_id", day: str = "hospital_day") -> DataFrame:
    """Exposed days up to each cutoff day, parenteral and by any route.

    A count is NULL (not 0) for a person with no exposed day up to that cutoff.
    """
    parenteral = F.col("parenteral_exposure")
    any_route = F.greatest(parenteral, F.col("enteral_exposure"), F.lit(0))
    return by_day.groupBy(id).agg(*(
        F.sum(F.when(F.col(day) <= k, value)).alias(f"{kind}_days_to_day_{k}")
        for kind, value in (("parenteral", parenteral), ("any", any_route)) for k in cutoffs))


def early_use_count(exposures: DataFrame, day_lt: int = 2, id: str = "person_id",
                    name: str = "early_use") -> DataFrame:
    """Exposure-day rows per person before the given day."""
    return (exposures.where(F.col("hospital_day") < day_lt)
            .groupBy(id).agg(F.count(F.lit(1)).alias(name)))
