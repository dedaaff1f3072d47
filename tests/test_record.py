"""The one-pass record equals the parts computed one by one, reads each table once and splits a hot person."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F
from test_analysis import published
from test_scale import plan_of, settings

from cohortkit.operators import analysis, record
from cohortkit.plans.study import Study, StudyParams
from cohortkit.sources.lookups import lookup_table


def events(spark, day, n, seed=3):
    """Random event tables with gaps in every column, repeated rows and inverted intervals."""
    rng = random.Random(seed)
    gap = lambda x: None if rng.random() < 0.04 else x
    person = lambda: gap(rng.randint(1, 4))
    on = lambda lo=-4, hi=16: gap(day(rng.randint(lo, hi)))
    labs = (3010813, 44817130, 1)
    value = lambda: gap(rng.choice([0.1, 0.4, 0.6, 11.0, float("nan")]))
    drugs = [(person(), (s := on()), gap(day(rng.randint(-3, 14))), gap(rng.randint(100, 104)),
              gap(rng.choice(["Vancomycin Injection", "amoxicillin oral", "other"])),
              gap(rng.choice([0, 4132161, 4171047]))) for _ in range(n)]
    make = lambda rows, schema: spark.createDataFrame(rows + rows[:5], schema)
    return {
        "drugs": make(drugs, "person_id long, drug_exposure_start_date date, drug_exposure_end_date date, "
                             "drug_concept_id int, drug_concept_name string, route_concept_id int"),
        "measurements": make([(i, person(), gap(rng.choice(labs)), value(), on(-1, 4), None) for i in range(n)],
                             "measurement_id long, person_id long, measurement_concept_id int, value double, "
                             "measurement_date date, measurement_datetime timestamp"),
        "conditions": make([(person(), gap(rng.choice([50, 51, 193688])), "c", on()) for _ in range(n)],
                           "person_id long, condition_concept_id int, condition_concept_name string, "
                           "condition_start_date date"),
        "procedures": make([(person(), gap(rng.randint(60, 63)), on()) for _ in range(n)],
                           "person_id long, procedure_concept_id int, procedure_date date"),
        "observations": make([(person(), gap(rng.choice([50, 60, 62, 70])), on()) for _ in range(n)],
                             "person_id long, observation_concept_id int, observation_date date"),
        "injuries": spark.createDataFrame([(50,), (50,), (None,)], "concept_id int"),   # listed twice counts twice
    }


def study_of(spark, day, tables, **params):
    base = published(spark, day)
    return Study(lambda role: tables[role] if role in tables else base.src(role), partial(lookup_table, spark),
                 StudyParams(min_site_rows=1, **params))


@pytest.mark.parametrize("n", [0, 6, 90])
def test_one_pass_equals_the_parts(spark, day, rows, n):
    tables = events(spark, day, max(n, 6))
    if n == 0:
        tables = {name: df.limit(0) for name, df in tables.items()}
    study = study_of(spark, day, tables, long_episode=3)
    parts = analysis.analysis_cohort(study.base_cohort, study.parts, study.regions)
    assert study.wide.dtypes == parts.dtypes
    assert rows(study.wide) == rows(parts) and study.wide.count() == 2


def test_routes_are_listed_once(spark):
    assert lookup_table(spark, "routes").groupBy("concept_id").count().where("count > 1").isEmpty()


def test_each_table_is_read_once(spark, day, tmp_path):
    stored = {}
    for role, df in events(spark, day, 20).items():
        df.write.parquet(f"{tmp_path}/{role}")
        stored[role] = spark.read.parquet(f"{tmp_path}/{role}")
    study = study_of(spark, day, stored)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        lines = plan_of(study.wide).splitlines()
    columns = {"drugs": "drug_concept_id", "measurements": "measurement_concept_id",
               "conditions": "condition_concept_id", "procedures": "procedure_concept_id",
               "observations": "observation_concept_id"}
    scans = {role: sum("FileScan" in x and c in x for x in lines) for role, c in columns.items()}
    # drugs once for the rates, once for the record
    assert scans == {"drugs": 2, "measurements": 1, "conditions": 1, "procedures": 1, "observations": 1}
    # all listed events meet the cohort in one join, and the grouping by person needs no exchange after it
    body = "\n".join(lines).split("collect_set", 1)[1].split("SortMergeJoin [person_id", 1)[0]
    assert "Exchange" not in body


def test_hot_person_is_split(spark, day):
    people = spark.range(200).select(F.col("id").alias("person_id"), F.lit(day(0)).alias("index_start"),
                                     F.lit(day(12)).alias("index_end"))
    rows = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 5 < 3, 7).otherwise(F.col("id") % 200).alias("person_id"),
        F.date_add(F.lit(day(0)), (F.col("id") % 6).cast("int")).alias("date"), F.col("id"))
    labs = rows.select("person_id", "date", (F.col("id") / 1e6).alias("pct"),
                       F.struct(F.lit(None).cast("timestamp").alias("at"), F.sha2(F.col("id").cast("string"), 256)
                                .alias("tie"), F.col("id").cast("double").alias("value")).alias("wbc"))
    none = spark.createDataFrame([], "person_id long, date date, last date, parenteral boolean, any boolean, "
                                     "extended long, vasopressor long, trauma long, late boolean, "
                                     "procedure long, imv long, ecmo long, trauma_observation long")
    more = rows.select("person_id", "date", F.lit(1).cast("long").alias("trauma"),
                       F.lit(1).cast("long").alias("imv"))
    key = "spark.sql."
    with settings(spark, **{key + "autoBroadcastJoinThreshold": "-1", key + "shuffle.partitions": "16",
                            key + "adaptive.advisoryPartitionSizeInBytes": "64KB",
                            key + "adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB"}):
        done = record.person_record([labs, none, more], people, long_episode=6)
        got = {r.person_id: r for r in done.collect()}
        assert "skew=true" in plan_of(done)
    assert len(got) == 81 and got[7].trauma_count == 36000
    assert sum(r.trauma_count for r in got.values()) == 60000
    assert all(r.pct_group == "low" for r in got.values())
    # days 0 to 5 all hold an event of the hot person: one run of six
    assert got[7].long_imv_count == 1


def test_long_runs_against_brute_force(spark):
    def brute(days, least):
        runs, last = [], None
        for d in sorted(days):
            if last is None or d - last > 2:
                runs.append(0)
            runs[-1], last = runs[-1] + 1, d
        return sum(r >= least for r in runs)

    rng = random.Random(5)
    data = [(i, rng.sample(range(40), rng.randint(0, 25))) for i in range(200)]
    df = spark.createDataFrame(data, "i int, days array<int>")
    for least in (1, 3, 14):
        got = {r.i: r.n for r in df.select("i", record.long_runs(F.col("days"), least, 2).alias("n")).collect()}
        assert got == {i: brute(d, least) for i, d in data}
