"""Cohort selection, index-date calendars and concept sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortkit.sources.lookups import HORIZON_DAYS


def base_cohort(facts: DataFrame, indicator: str = "hospitalized") -> DataFrame:
    """Rows whose 0/1 indicator is 1."""
    return facts.where(F.col(indicator) == 1)


def index_calendar(cohort: DataFrame, id: str = "person_id", start: str = "index_start",
                   days: int = HORIZON_DAYS) -> DataFrame:
    """One row per person and day, from the index date (day 0) to day ``days``."""
    return (cohort
            .select(id, start, F.explode(F.sequence(F.lit(0), F.lit(days))).alias("hospital_day"))
            .select(id, start, F.date_add(start, F.col("hospital_day")).alias("date"),
                    "hospital_day"))


def concept_set(members: DataFrame, codeset_id: int | None = None, set_name: str | None = None,
                latest: bool = True) -> DataFrame:
    """Concept ids of one set, by id or by name; by default its latest version only.

    The version flag may be a boolean or the text 'true' / 'false'.
    """
    if (codeset_id is None) == (set_name is None):
        raise ValueError("give exactly one of codeset_id and set_name")
    wanted = (F.col("codeset_id") == codeset_id if set_name is None
              else F.col("concept_set_name") == set_name)
    if latest:
        wanted = wanted & F.col("is_most_recent_version").cast("boolean")
    return members.where(wanted).select("concept_id")
