"""Ranks, cumulative counts and exact quantiles that never need one big group.

A plain window over a hot key sorts that key's rows in one task.  These helpers
cut each key into ordered buckets, count the buckets, and add the running
bucket total to a rank taken inside each bucket.  Bucket membership is a pure
function of the row, so a re-run task rebuilds the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortkit.session import checkpoint

#: Rows of a value range that one task sorts, on average.
RANGE_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on same-named keys in which NULL meets NULL."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b,
                   [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, match).drop(*(f"_r_{k}" for k in keys))


def _offsets(counts: DataFrame, keys: Sequence[str], bucket: str, sums: Sequence[str]) -> DataFrame:
    """Running totals of ``sums`` over the buckets before each one."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys, bucket,
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums))


def bucketed_row_number(df: DataFrame, keys: Sequence[str], bucket: Column,
                        order: Sequence[str], name: str = "seq_no") -> DataFrame:
    """row_number over ``keys`` in the order (bucket, *order), skew-safe.

    The bucket must not decrease along the wanted order (a truncated timestamp),
    or may be any hash of the row when only a fixed order is needed.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = _offsets(counts, keys, "_bucket", ["n"])
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (null_safe_join(keyed.withColumn("_inside", inside), offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before_n") + F.col("_inside"))
            .drop("_bucket", "_inside", "_before_n"))


def _cut(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: which of about ``buckets`` equal-count ranges holds the value.

    Only the cut points (at most ``buckets`` numbers) reach the driver.
    """
    probs = [i / buckets for i in range(1, buckets)]
    points = df.approxQuantile(value, probs, 0.25 / buckets)
    splits = sorted({p for p in points if p is not None and math.isfinite(p)})
    return (Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=value, outputCol="_bucket")
            .transform(df) if splits else df.withColumn("_bucket", F.lit(0.0)))


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str, counts: Sequence[str],
                      buckets: int = 64) -> DataFrame:
    """Per distinct value: its counts and their running totals within ``by``.

    ``df`` holds one row per (by, value) with the ``counts`` columns, and is best
    a written table; the output adds ``cum_<count>`` including the row itself.
    There are at least ``buckets`` ranges, and more once a range would hold over
    ``RANGE_ROWS`` rows, so what one task sorts does not grow with the data.
    """
    buckets = max(buckets, math.ceil(df.count() / RANGE_ROWS))
    cut = _cut(df.withColumn(value, F.col(value).cast("double")), value, buckets)
    totals = cut.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(c) for c in counts))
    offsets = _offsets(totals, by, "_bucket", counts)
    inside = (Window.partitionBy(*by, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = cut.select("*", *(F.sum(c).over(inside).alias(f"cum_{c}") for c in counts))
    return (null_safe_join(sums, offsets, [*by, "_bucket"])
            .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_before_{c}") for c in counts})
            .drop("_bucket", *(f"_before_{c}" for c in counts)))


def known_number(value: str) -> Column:
    """Neither NULL nor NaN."""
    number = F.col(value).cast("double")
    return number.isNotNull() & ~F.isnan(number)


def value_ranges(df: DataFrame, value: str, rows: int) -> DataFrame:
    """Add ``_range``: which of the value ranges of about ``rows`` rows each holds the value.

    Ranges ascend with the value; equal values share one.
    """
    buckets = math.ceil(df.count() / rows)
    if buckets < 2:
        return df.withColumn("_range", F.lit(0))
    return _cut(df, value, buckets).withColumn("_range", F.col("_bucket").cast("int")).drop("_bucket")


def quantile_label(prob: float) -> str:
    return f"p{round(prob * 100):02d}" if prob not in (0, 1) else f"p{round(prob * 100)}"


def value_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    buckets: int = 64) -> DataFrame:
    """Exact linearly interpolated quantiles of a column with many distinct values.

    Returns by..., n, and one column per probability (p00, p25, ...).  NULLs and
    NaNs are left out; groups without a value are absent.  Works on value counts,
    so neither a group nor its distinct values sit in one task.  The counts are
    written once: three passes read them, and the source only one.
    """
    freq = checkpoint(
        df.where(known_number(value))
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n")))
    keyed = freq if by else freq.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    cum = cumulative_counts(keyed, keys, "value", ["n"], buckets)
    totals = keyed.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = null_safe_join(cum, totals, keys)
    aggs = []
    for p in probs:
        # 0-based position of the quantile and its two neighbours in rank order
        pos = F.lit(float(p)) * (F.col("total") - 1)
        holds = lambda k: (F.col("cum_n") - F.col("n") <= k) & (k < F.col("cum_n"))
        low = F.max(F.when(holds(F.floor(pos)), F.col("value")))
        high = F.max(F.when(holds(F.ceil(pos)), F.col("value")))
        aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(quantile_label(p)))
    return ranked.groupBy(*keys).agg(F.max("total").alias("n"), *aggs).drop("_all")


def day_quantiles(df: DataFrame, by: Sequence[str], value: str,
                  probs: Sequence[float]) -> DataFrame:
    """As ``value_quantiles`` for a column with few distinct values (day counts).

    Counts per value first, then the built-in weighted percentile on the counts.
    """
    freq = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count(F.lit(1)).alias("_n")))
    return freq.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        *(F.percentile(value, float(p), F.col("_n")).alias(quantile_label(p)) for p in probs))
