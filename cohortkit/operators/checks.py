"""Data-quality checks on the cohort and on the route rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortkit.functions.expressions import flag
from cohortkit.sources.lookups import MIN_SITE_ROWS


def check_window(cohort: DataFrame, date: str = "first_positive", index: str = "index_start",
                 lo: int = -16, hi: int = 2) -> DataFrame:
    """Members whose date lies outside [index+lo, index+hi]; a missing date is not reported."""
    return cohort.where(~F.col(date).between(F.date_add(index, lo), F.date_add(index, hi)))


def check_unique(cohort: DataFrame, id: str = "person_id") -> DataFrame:
    """Row count next to the distinct id count."""
    return cohort.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(id).alias("n_ids"))


def check_partner_threshold(counts: DataFrame, min_rows: int = MIN_SITE_ROWS) -> DataFrame:
    """How many sites have more than ``min_rows`` rows."""
    return (counts.where(F.col("record_count") > min_rows)
            .agg(F.count(F.lit(1)).alias("n_partners")))


def check_rule_coverage(routed: DataFrame) -> DataFrame:
    """Share of exposure days resolved by the curated list, and by any rule."""
    e, p = F.col("is_enteral_strategy"), F.col("is_parenteral_strategy")
    n = F.count(F.lit(1))
    return routed.agg(
        F.try_divide(F.sum(flag((p == 4) | (e == 4))), n).alias("share_by_list"),
        F.try_divide(F.sum(flag((p <= 4) | (e <= 4))), n).alias("share_resolved"))


def spot_check(df: DataFrame, col: str, value) -> DataFrame:
    """Rows where the column has exactly this value."""
    return df.where(F.col(col) == value)
