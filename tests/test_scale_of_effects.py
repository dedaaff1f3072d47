"""Effect queries read their source once, score without repeating expressions, and walk scores in little memory."""

import threading
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortkit.functions.design import Design
from cohortkit.operators import matching
from cohortkit.plans import effects


def test_a_score_names_its_place_once(spark):
    design = Design([], {}, {"x": (0.0, 9.0, 10), "z": (0.0, 9.0, 10)}, {})
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("z"))
    beta = np.arange(21) / 10
    scored = design.add_link(df, beta, "link")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("floor(") == 2                       # once a smooth term
    pdf = df.toPandas()
    assert np.allclose([r.link for r in scored.collect()], design.matrix(pdf) @ beta)


def test_imputed_effects_read_their_source_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 600
    flags = [*effects.EARLY, "obesity", "smoker", "target", *effects.OUTCOMES]
    pdf = pd.DataFrame({"person_id": np.arange(n), "month": rng.integers(0, 3, n), "race_ethnicity": rng.choice(["x", "y"], n),
                        "age": rng.integers(20, 90, n), "CCI": rng.integers(0, 9, n), **{c: rng.integers(0, 2, n) for c in flags},
                        "wbc": np.where(rng.random(n) < 0.2, np.nan, rng.normal(9, 2, n)), "bmi": rng.normal(28, 4, n)})
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(pdf)
    _, balance = effects.imputed_matched_effects(df.mapInPandas(seen, df.schema), "mean")
    assert balance.count() > 0 and read.value == n


def test_imputed_copies_are_matched_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 60
    flags = [*effects.EARLY, "obesity", "smoker", "target", *effects.OUTCOMES]
    pdf = pd.DataFrame({"person_id": np.arange(n), "month": 0, "race_ethnicity": "x", "age": rng.integers(20, 90, n),
                        "CCI": rng.integers(0, 9, n), **{c: rng.integers(0, 2, n) for c in flags},
                        "wbc": np.where(rng.random(n) < 0.2, np.nan, rng.normal(9, 2, n)), "bmi": rng.normal(28, 4, n)})
    both, seen = threading.Barrier(2), []

    def match(copy, *args, **kwargs):
        both.wait(60)                                              # for the match of the other copy
        seen.append(spark.sparkContext.getLocalProperty("asked_by"))
        return effects.Matched(copy, None)

    monkeypatch.setattr(effects, "match_on_gam", match)
    spark.sparkContext.setLocalProperty("asked_by", "test")
    try:
        pooled, _ = effects.imputed_matched_effects(spark.createDataFrame(pdf), m=2, iters=1)
    finally:
        spark.sparkContext.setLocalProperty("asked_by", None)
    assert {(r.outcome, r.m) for r in pooled.collect()} <= {(y, 2) for y in effects.OUTCOMES}
    assert seen == ["test", "test"]


def test_walking_takes_little_memory():
    rng = np.random.default_rng(1)
    n = 60_000
    arm = rng.random(n) < 0.5
    pdf = pd.DataFrame({"key": "", "range": 0, "source": matching.OWN, "from": 0, "lo": 0, "hi": 0,
                        "place": np.sort(rng.random(n)), "start": 0, "t": arm * 1, "c": ~arm * 1})
    tracemalloc.start()
    out = matching.walk_range(pdf, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["n"][out["kind"] == 0].sum() == min(arm.sum(), (~arm).sum())
    assert peak < 340 * n                                          # bytes a place
