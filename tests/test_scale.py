"""Plans that must hold at scale: hot keys are split, scans are narrow, no cross joins."""

import re
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from cohortkit.operators import exposure, summary
from cohortkit.plans import registry
from cohortkit.session import checkpoint, shared_folder
from cohortkit.sources import sink

FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_person_is_split(spark, day):
    """A person holding 60% of the exposures is spread over several join tasks."""
    people = spark.range(200).select(F.col("id").alias("person_id"), F.lit(day(0)).alias("index_start"))
    events = spark.range(0, 40000, 1, 8).select(
        F.when(F.col("id") % 5 < 3, 7).otherwise(F.col("id") % 200).alias("person_id"),
        F.date_add(F.lit(day(0)), (F.col("id") % 20).cast("int")).alias("drug_exposure_start_date"),
        F.lit(None).cast("date").alias("drug_exposure_end_date"), F.lit(1).alias("drug_concept_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("drug_concept_name"),
        F.lit(0).alias("route_concept_id"))
    concepts = spark.createDataFrame([(1,)], "concept_id int")
    key = "spark.sql."
    with settings(spark, **{key + "autoBroadcastJoinThreshold": "-1",
                            key + "shuffle.partitions": "16",
                            key + "adaptive.advisoryPartitionSizeInBytes": "64KB",
                            key + "adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB"}):
        days = exposure.exposure_days(events, people, concepts).groupBy(
            "person_id", "hospital_day").agg(F.count(F.lit(1)).alias("n"),
                                             F.max("drug_concept_name").alias("name"))
        got = {(r.person_id, r.hospital_day): r.n for r in days.collect()}
        assert "skew=true" in plan_of(days)
    assert sum(got.values()) == 40000
    assert sum(n for (p, _), n in got.items() if p == 7) == 24000


def test_hot_value_in_rank_sum(spark):
    """A third of the rows share one value: value counts keep it one row."""
    df = spark.range(9000).select((F.col("id") % 2).cast("int").alias("target"),
                                  F.when(F.col("id") % 3 == 0, 5.0)
                                  .otherwise((F.xxhash64("id") % 1000) / 10).alias("v"))
    got = [summary.rank_sum(df, "target", ["v"], buckets=b).first() for b in (2, 64)]
    assert got[0].w == got[1].w and got[0].z == pytest.approx(got[1].z)


@with_tables
@pytest.mark.parametrize("name", ["exposure_days", "apply_exclusions", "lab_sequence", "rank_sum",
                                  "propensity_match", "balance_table", "calibration_bins"])
def test_no_cross_joins(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


@with_tables
def test_filters_reach_the_scan(spark):
    plan = plan_of(registry.timeline_study(spark, FOLDER).exposures)
    scan = next(line for line in plan.splitlines() if "events.parquet" in line and "value" in line)
    assert "EqualTo(event_type,purchase)" in scan
    assert "event_id" not in scan.split("ReadSchema")[1]


@with_tables
def test_person_joins_share_one_shuffle(spark):
    """The wide frame shuffles its left side by person once, whatever the number of parts."""
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        study = registry.timeline_study(spark, FOLDER, stored_facts=True)
        plan = plan_of(study.base_cohort.join(study.exposure_counts, "person_id", "left")
                       .join(study.early_pct, "person_id", "left")
                       .join(study.first_wbc, "person_id", "left"))
    joins = [line for line in plan.splitlines() if "SortMergeJoin [person_id" in line
             and "LeftOuter" in line]
    assert len(joins) == 3
    # each outer join's left input is the join below it, without an exchange between
    body = plan.split("SortMergeJoin [person_id", 1)[1]
    assert "Exchange" not in body.split("SortMergeJoin [person_id", 1)[0]


def test_checkpoint_cuts_lineage(spark, rows):
    df = spark.range(10).selectExpr("id", "id * 2 as v")
    kept = checkpoint(df)
    assert rows(kept) == rows(df) and kept.dtypes == df.dtypes
    assert "Range" not in plan_of(kept) and "FileScan parquet" in plan_of(kept)
    assert shared_folder(spark)


def test_stored_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(3000).select((F.col("id") % 300).alias("person_id"), F.col("id").alias("a"))
    hot = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 300).alias("person_id"),
                                   (F.col("id") * 2).alias("b"))
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        x = sink.store(left, "scale_left", buckets=8, folder=str(tmp_path))
        y = sink.store(hot, "scale_hot", buckets=8, folder=str(tmp_path))
        joined = x.join(y, "person_id").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
        assert "Exchange" not in plan_of(joined)
        want = left.join(hot, "person_id").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(joined.collect()) == sorted(want.collect())
        # written again: replaced; empty: no rows
        assert sink.store(left.limit(0), "scale_left", buckets=8, folder=str(tmp_path)).count() == 0
    spark.sql("DROP TABLE scale_left")
    spark.sql("DROP TABLE scale_hot")


@with_tables
def test_study_datasets_are_stored_by_name(spark, tmp_path):
    study = registry.timeline_study(spark, FOLDER)
    stored = sink.write_datasets(study, ["base_cohort", "severity", "rates"], "scale_", buckets=4, folder=str(tmp_path))
    assert sorted(stored) == ["base_cohort", "rates", "severity"]
    assert stored["base_cohort"].count() == study.base_cohort.count()
    assert "Bucketed: true" in plan_of(stored["severity"].groupBy("person_id").count())
    for name in stored:
        spark.sql(f"DROP TABLE scale_{name}")
