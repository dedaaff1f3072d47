"""Counts, rates and month trends, and the frames behind the figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.functions.expressions import flag
from cohortkit.functions.ordering import day_quantiles
from cohortkit.session import checkpoint

MONTH = "reporting_period"


def _rows() -> Column:
    return F.count(F.lit(1))


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str], variable: str, value: str,
          cast: str | None = None) -> DataFrame:
    """Unpivot the columns, cast to one type first where they differ."""
    if cast:
        df = df.select(*keys, *(F.col(c).cast(cast).alias(c) for c in cols))
    return df.unpivot(list(keys), list(cols), variable, value)


def partner_counts(df: DataFrame, key: str = "data_partner_id") -> DataFrame:
    """Rows per site."""
    return df.groupBy(key).agg(_rows().cast("int").alias("record_count"))


def concept_frequency(df: DataFrame, concept: str, name: str, where: Column | None = None,
                      pick: str = "max", count: str = "occurrence_count") -> DataFrame:
    """Rows per concept with one of its names, most frequent first."""
    chosen = {"max": F.max, "min": F.min}[pick](name).alias(name)
    rows = df if where is None else df.where(where)
    return (rows.groupBy(concept).agg(chosen, _rows().alias(count))
            .orderBy(F.desc(count), concept))


def center_month(df: DataFrame, key: str = "data_partner_id", month: str = MONTH,
                 y: str = "target") -> DataFrame:
    """Per group and month: rows, outcome count and outcome mean."""
    return df.groupBy(key, month).agg(
        _rows().cast("int").alias("case_count"), F.sum(y).cast("int").alias("exposure_count"),
        F.avg(y).alias("exposure_average"))


def month_stats(df: DataFrame, month: str = MONTH, y: str = "target") -> DataFrame:
    """Per month: rows, events, non-events, rate; oldest first."""
    return (df.groupBy(month)
            .agg(_rows().alias("n"), F.sum(y).alias("events"),
                 (_rows() - F.sum(y)).alias("non_events"), F.avg(y).alias("rate"))
            .orderBy(month))


def month_covariates(df: DataFrame, cols: Mapping[str, str], month: str = MONTH) -> DataFrame:
    """Per month: rows and the sum of each indicator (output name -> column)."""
    return df.groupBy(month).agg(
        _rows().alias("encounter_count"), *(F.sum(c).alias(name) for name, c in cols.items()))


def overall_rates(df: DataFrame, cols: Sequence[str], total: str = "target") -> DataFrame:
    """Mean of each indicator and the total of one, over all rows."""
    return df.agg(*(F.avg(c).alias(c) for c in cols), F.sum(total).alias(f"total_{total}"))


def condition_rates(conditions: DataFrame, cohort: DataFrame, concept: DataFrame,
                    rates: Mapping[str, str], key: str = "condition_concept_id",
                    id: str = "person_id") -> DataFrame:
    """Per condition: persons having it and the share of them with each treatment.

    Names join after the counting, when there is one row per condition.
    """
    pairs = conditions.select(id, key).distinct()
    per = (pairs.join(cohort.select(id, *rates.values()), id, "left").groupBy(key)
           .agg(_rows().alias("case_count"), *(F.avg(c).alias(n) for n, c in rates.items())))
    names = (concept.groupBy(F.col("concept_id").alias(key))
             .agg(F.min("concept_name").alias("concept_name")))
    return (per.join(names, key, "left")
            .select(key, "concept_name", "case_count", *rates)
            .orderBy(F.desc("case_count"), key))


def strata_month_rate(df: DataFrame, strata: Sequence[str], y: str = "target",
                      month: str = MONTH) -> DataFrame:
    """Outcome mean per month within every level of every stratum, in long form.

    Unpivoted before grouping: the map-side table holds one entry per level and
    month, so almost nothing is shuffled.
    """
    long = _long(df, [month, y], strata, "stratum", "level", cast="string")
    return long.groupBy("stratum", "level", month).agg(
        _rows().alias("count"), F.avg(y).alias("avg"))


def month_prevalence(df: DataFrame, cols: Mapping[str, str], month: str = MONTH) -> DataFrame:
    """Per month: rows and the mean of each indicator (output name -> column)."""
    return df.groupBy(month).agg(
        _rows().alias("n"), *(F.avg(c).alias(name) for name, c in cols.items()))


def outcome_ratio(df: DataFrame, cols: Sequence[str], base: str = "target",
                  month: str = MONTH) -> DataFrame:
    """Monthly mean of each outcome, and its ratio to the monthly mean of ``base``."""
    means = month_prevalence(df, {c: c for c in [base, *cols]}, month)
    return means.select("*", *(F.try_divide(c, base).alias(f"{c}_c") for c in cols))


def trends_long(df: DataFrame, names: Mapping[str, str], month: str = MONTH) -> DataFrame:
    """Monthly means in long form; ``names`` maps a column to its display name."""
    means = df.groupBy(month).agg(*(F.avg(c).alias(label) for c, label in names.items()))
    return _long(means, [month], list(names.values()), "metric", "rate")


def box_summary(center: DataFrame, month: str = MONTH, y: str = "exposure_average") -> DataFrame:
    """Minimum, quartiles and maximum over the sites of each month."""
    return day_quantiles(center, [month], y, (0, 0.25, 0.5, 0.75, 1))


def top_n_lump(counts: DataFrame, n: int = 10, label: str = "drug_name", weight: str = "c",
               by: str = "hospital_day", other: str = "Other") -> DataFrame:
    """Counts per day with all but the ``n`` heaviest labels lumped together.

    Ties at the boundary are kept; a single remaining label is not lumped, and a
    missing label is a level of its own.  The counts (one row per day and label)
    are written once, as four small passes read them.
    """
    named = checkpoint(counts.select(
        by, F.coalesce(F.initcap(label), F.lit("(Missing)")).alias(label), weight))
    totals = named.groupBy(label).agg(F.sum(weight).alias("_w"))
    cutoff = totals.orderBy(F.desc("_w")).limit(n).agg(F.min("_w").alias("_cut"))
    heavy = totals.where(F.col("_w") >= cutoff.scalar())
    light = totals.where(F.col("_w") < cutoff.scalar()).agg(_rows())
    kept = heavy.select(label, F.lit(True).alias("_keep"))
    lumped = (named.join(kept, label, "left")
              .withColumn(label, F.when(F.col("_keep") | (light.scalar() <= 1), F.col(label))
                          .otherwise(F.lit(other))))
    return lumped.groupBy(by, label).agg(F.sum(weight).alias(weight))


def center_vs_overall(center: DataFrame, overall: DataFrame, month: str = MONTH) -> DataFrame:
    """Each site-month next to the overall rate of that month."""
    return center.join(overall.select(month, "rate"), month)


def los_summary(df: DataFrame, where: Column, y: str = "total_length_of_stay") -> DataFrame:
    """Rows, median, mean and quartiles of a day count among the selected rows.

    One weighted pass over the (few) distinct day counts.
    """
    freq = df.where(where).groupBy(y).agg(_rows().alias("_n"))
    known = F.col(y).isNotNull()
    pct = lambda p: F.percentile(y, p, F.col("_n"))
    return freq.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), pct(0.5).alias("median"),
        (F.sum(F.col(y) * F.col("_n")) / F.sum(F.when(known, F.col("_n")))).alias("mean"),
        pct(0.25).alias("p25"), pct(0.75).alias("p75"))


def conditional_means(df: DataFrame, cols: Mapping[str, Column | str], y: str = "target",
                      month: str = MONTH) -> DataFrame:
    """Monthly outcome mean among the rows where each indicator is 1."""
    return df.groupBy(month).agg(*(
        F.avg(F.when((F.col(c) if isinstance(c, str) else c) == 1, F.col(y))).alias(name)
        for name, c in cols.items()))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence | None = None) -> DataFrame:
    """Counts of row level x column level, one output column per column level.

    Cells with no rows are NULL.  Give ``levels`` to skip the job that lists them.
    """
    grouped = df.groupBy(row).pivot(col, list(levels)) if levels else df.groupBy(row).pivot(col)
    return grouped.agg(_rows())


def threshold_grid(df: DataFrame, outcomes: Mapping[str, int], lowest: int = 3) -> DataFrame:
    """Rows and events (value >= k) for k from ``lowest`` to each outcome's top value.

    Counts per (outcome, value) first; only those few rows meet the thresholds.
    """
    long = _long(df, [], list(outcomes), "outcome", "_value", cast="int")
    freq = long.groupBy("outcome", "_value").agg(_rows().alias("_n"))
    top = F.create_map(*(F.lit(x) for pair in outcomes.items() for x in pair))[F.col("outcome")]
    steps = F.when(top >= lowest, F.sequence(F.lit(lowest), top))
    return (freq.withColumn("threshold", F.explode(steps))
            .groupBy("outcome", "threshold")
            .agg(F.sum("_n").alias("n"),
                 F.sum(F.col("_n") * flag(F.col("_value") >= F.col("threshold"))).alias("events")))


def calibration_bins(df: DataFrame, score: str, y: str = "target", bins: int = 10) -> DataFrame:
    """Rows and outcome mean in equal-width score bins, closed on the right.

    The lowest score belongs to the first bin; empty bins are absent.
    """
    ends = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    step = F.try_divide((F.col(score) - lo) * bins, hi - lo)
    number = F.greatest(F.lit(1), F.ceil(F.coalesce(step, F.lit(1.0))).cast("int"))
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.least(number, F.lit(bins)).alias("bin"))
            .agg(_rows().alias("n"), F.avg(y).alias("r")))
