"""Events on the index-date timeline: flags, labs, windows, episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cohortkit.functions.expressions import flag, within_days
from cohortkit.functions.ordering import bucketed_row_number, day_quantiles


def severity_by_day(cohort: DataFrame, events: Sequence[tuple[DataFrame, str, str]],
                    sets: Mapping[str, DataFrame], id: str = "person_id",
                    start: str = "index_start", end: str = "index_end") -> DataFrame:
    """Per person and day of the stay, a 0/1 flag per concept set.

    ``events`` lists (table, concept column, date column).  Days with events but
    no listed concept are kept with zeros.  The sets become one table with a
    column per flag, joined once; no id list passes through the driver.
    """
    rows = reduce(DataFrame.unionByName, [
        df.select(id, F.col(concept).alias("concept_id"), F.col(date).alias("date"))
        for df, concept, date in events])
    # one row per person, day and concept is all the flags need: a person with
    # very many events shrinks before the join instead of piling up in it
    seen = rows.where(F.col("date").isNotNull()).distinct()
    tagged = reduce(DataFrame.unionByName, [
        df.select("concept_id", F.lit(name).alias("_set")) for name, df in sets.items()])
    flags = tagged.groupBy("concept_id").agg(*(
        F.max(flag(F.col("_set") == name)).alias(name) for name in sets))
    stay = cohort.select(id, F.col(start).alias("_start"), F.col(end).alias("_end"))
    return (seen.join(stay, id).where(F.col("date").between(F.col("_start"), F.col("_end")))
            .join(flags, "concept_id", "left")
            .groupBy(id, F.datediff("date", "_start").alias("hospital_day"))
            .agg(*(F.coalesce(F.max(name), F.lit(0)).alias(name) for name in sets)))


def early_severity(by_day: DataFrame, flags: Sequence[str] = ("imv", "ecmo"), day_lt: int = 2,
                   id: str = "person_id") -> DataFrame:
    """Each flag's maximum before the given day, as early_<flag>."""
    return (by_day.where(F.col("hospital_day") < day_lt).groupBy(id)
            .agg(*(F.max(f).alias(f"early_{f}") for f in flags)))


def labs_in_stay(measurements: DataFrame, lookup: DataFrame, cohort: DataFrame,
                 id: str = "person_id", concept: str = "measurement_concept_id",
                 value: str = "value", date: str = "measurement_date",
                 start: str = "index_start", end: str = "index_end") -> DataFrame:
    """Non-missing measurements of the listed concepts inside the stay, with the day."""
    listed = (measurements.where(F.col(value).isNotNull())
              .join(lookup.select(F.col("concept_id").alias(concept), "measure_name"), concept))
    stay = cohort.select(id, F.col(start).alias("_start"), F.col(end).alias("_end"))
    return (listed.join(stay, id)
            .where(F.col(date).between(F.col("_start"), F.col("_end")))
            .withColumn("hospital_day", F.datediff(date, "_start"))
            .drop("_start", "_end"))


def lab_sequence(labs: DataFrame, id: str = "person_id", at: str = "measurement_datetime",
                 tie: str = "measurement_id") -> DataFrame:
    """Number each person's results per measure by time (then by ``tie``).

    Ranked inside each hour and shifted by the running hour counts, so one
    person's results are never sorted in a single task.
    """
    return bucketed_row_number(labs, [id, "measure_name"], F.date_trunc("hour", at), [at, tie])


def first_value(labs: DataFrame, measure: str, name: str | None = None, id: str = "person_id",
                value: str = "value", at: str = "measurement_datetime",
                tie: str = "measurement_id") -> DataFrame:
    """Each person's first result of one measure: the row numbered 1, without numbering.

    min_by combines map-side, so nothing is sorted.
    """
    return (labs.where(F.col("measure_name") == measure).groupBy(id)
            .agg(F.min_by(value, F.struct(at, tie)).alias(name or measure)))


def early_max_band(labs: DataFrame, measure: str = "pct", cut: float = 0.5, day_lt: int = 2,
                   id: str = "person_id", value: str = "value",
                   name: str = "pct_group") -> DataFrame:
    """'high' if a person's largest early result exceeds the cut, else 'low'."""
    return (labs.where((F.col("hospital_day") < day_lt) & (F.col("measure_name") == measure))
            .groupBy(id)
            .agg(F.when(F.max(value) > cut, "high").otherwise("low").alias(name)))


def events_in_window(cohort: DataFrame, events: DataFrame, date: str, lo=None, hi=None,
                     id: str = "person_id", index: str = "index_start",
                     bounds: Sequence[str] = ()) -> DataFrame:
    """Events whose date lies in [index+lo, index+hi]; None leaves a side open.

    ``lo`` / ``hi`` may also be columns; name the cohort columns they use in
    ``bounds``.  Returns the event columns only.
    """
    members = cohort.select(id, F.col(index).alias("_index"), *bounds)
    return (events.join(members, id)
            .where(within_days(F.col(date), F.col("_index"), lo, hi))
            .select(*events.columns))


def windowed_event_count(cohort: DataFrame, events: DataFrame, concepts: DataFrame, concept: str,
                         date: str, lo=None, hi=None, name: str = "n", id: str = "person_id",
                         index: str = "index_start", bounds: Sequence[str] = (),
                         distinct: bool = False) -> DataFrame:
    """Events of the listed concepts inside the window, counted per person.

    A concept listed k times counts k times, as in an inner join with the list;
    with ``distinct`` it counts once.  Counted per (person, date) before the join,
    so it moves at most one row per person and date however many events a person has.
    """
    times = concepts.groupBy(F.col("concept_id").alias(concept)).agg(
        (F.lit(1) if distinct else F.count(F.lit(1))).cast("long").alias("_times"))
    daily = events.join(times, concept).groupBy(id, date).agg(F.sum("_times").alias("_n"))
    inside = events_in_window(cohort, daily, date, lo, hi, id, index, bounds)
    return inside.groupBy(id).agg(F.sum("_n").alias(name))


def first_onset(events: DataFrame, ids: Sequence[int] | DataFrame, concept: str, date: str,
                name: str = "onset", id: str = "person_id") -> DataFrame:
    """Each person's earliest date among the listed concepts."""
    if isinstance(ids, DataFrame):
        listed = events.join(ids.select(F.col("concept_id").alias(concept)), concept, "left_semi")
    else:
        listed = events.where(F.col(concept).isin(list(ids)))
    return listed.groupBy(id).agg(F.min(date).alias(name))


def assign_courses(days: DataFrame, id: str = "person_id", day: str = "hospital_day",
                   max_gap: int = 2, name: str = "course_id") -> DataFrame:
    """Number runs of days per person; a step of more than ``max_gap`` starts a new run.

    Expects one row per person and day, so a person is at most a stay's days.
    Both windows share one shuffle and one sort.
    """
    by_day = Window.partitionBy(id).orderBy(day)
    previous = F.lag(day).over(by_day)
    starts = flag(previous.isNull() | (F.col(day) - previous > max_gap))
    return (days.select(id, day, starts.alias("_starts"))
            .select(id, day, F.sum("_starts").over(by_day).alias(name)))


def first_course_duration(courses: DataFrame, id: str = "person_id",
                          day: str = "hospital_day") -> DataFrame:
    """Last day minus first day of each person's first course (one day = 0)."""
    return (courses.where(F.col("course_id") == 1).groupBy(id)
            .agg((F.max(day) - F.min(day)).alias("duration")))


def course_for_cohort(durations: DataFrame, cohort: DataFrame, keep: Sequence[str],
                      id: str = "person_id") -> DataFrame:
    """Durations of the cohort's members with the named cohort columns."""
    return durations.join(cohort.select(id, *keep), id).select(id, *keep, "duration")


def gap_episodes(days: DataFrame, id: str = "person_id", day: str = "hospital_day",
                 join_lt: int = 3) -> DataFrame:
    """Runs of days less than ``join_lt`` apart; length is the number of days present."""
    runs = assign_courses(days, id, day, join_lt - 1, "sequence_no")
    return runs.groupBy(id, "sequence_no").agg(F.count(F.lit(1)).alias("length"))


def long_episodes(episodes: DataFrame, min_len: int = 14, id: str = "person_id",
                  name: str = "episode_count") -> DataFrame:
    """How many episodes of at least ``min_len`` days each person has."""
    return (episodes.where(F.col("length") >= min_len)
            .groupBy(id).agg(F.count(F.lit(1)).alias(name)))


def course_quantiles(durations: DataFrame, by: Sequence[str] = (),
                     probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of course duration, overall or per group."""
    return day_quantiles(durations, by, "duration", probs)
