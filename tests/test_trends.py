import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import summary, trends

M1, M2 = date(2020, 3, 1), date(2020, 4, 1)


@pytest.fixture
def stays(spark):
    return spark.createDataFrame(
        [(1, M1, 1, 1, "a"), (1, M1, 0, 0, "b"), (2, M1, 0, 1, None), (2, M2, 1, 1, "a")],
        "data_partner_id int, reporting_period date, target int, x int, g string")


def test_center_and_month(stays, rows):
    assert rows(trends.partner_counts(stays)) == [(1, 2), (2, 2)]
    assert rows(trends.center_month(stays)) == [(1, M1, 2, 1, 0.5), (2, M1, 1, 0, 0.0),
                                                (2, M2, 1, 1, 1.0)]
    stats = trends.month_stats(stays)
    assert [tuple(r)[1:4] for r in stats.collect()] == [(3, 1, 2), (1, 1, 0)]
    assert rows(trends.center_vs_overall(trends.center_month(stays), stats),
                "data_partner_id", "rate")[0] == (1, 1 / 3)
    assert rows(trends.month_covariates(stays, {"n_x": "x"})) == [(M1, 3, 2), (M2, 1, 1)]
    assert rows(trends.overall_rates(stays, ["target", "x"])) == [(0.5, 0.75, 2)]


def test_strata(stays, rows):
    got = trends.strata_month_rate(stays, ["x", "g"])
    assert ("x", "1", M1, 2, 0.5) in rows(got)
    assert ("g", None, M1, 1, 0.0) in rows(got)


def test_ratio_and_prevalence(stays):
    got = {r.reporting_period: r for r in trends.outcome_ratio(stays, ["x"]).collect()}
    assert got[M1].x_c == pytest.approx(2.0) and got[M2].x_c == 1.0
    none = trends.outcome_ratio(stays.withColumn("target", F.lit(0)), ["x"]).collect()
    assert all(r.x_c is None for r in none)


def test_trends_long(stays, rows):
    assert rows(trends.trends_long(stays, {"x": "X"})) == [(M1, "X", 2 / 3), (M2, "X", 1.0)]


def test_box_and_los(spark, rows):
    c = spark.createDataFrame([(M1, v) for v in (0.1, 0.2, 0.4, 0.8)],
                              "reporting_period date, exposure_average double")
    got = trends.box_summary(c).first()
    assert (got.p0, got.p25, got.p50, got.p100) == pytest.approx((0.1, 0.175, 0.3, 0.8))
    d = spark.createDataFrame([(1, 2), (1, 4), (1, 12), (1, None), (0, 99)],
                              "died int, total_length_of_stay int")
    got = trends.los_summary(d, F.col("died") == 1).first()
    assert (got.n, got["median"], got["mean"]) == (4, 4.0, 6.0)


def lumpable(spark, *pairs):
    return spark.createDataFrame([(0, k, v) for k, v in pairs],
                                 "hospital_day int, drug_name string, c int")


def test_top_n_lump(spark, rows):
    c = lumpable(spark, ("aa bb", 9), ("c", 5), ("d", 5), ("e", 1), (None, 2))
    assert rows(trends.top_n_lump(c, 2)) == [(0, "Aa Bb", 9), (0, "C", 5), (0, "D", 5),
                                             (0, "Other", 3)]
    # one label beyond the top is not lumped
    assert rows(trends.top_n_lump(c, 4)) == rows(trends.top_n_lump(c, 10))
    assert (0, "(Missing)", 2) in rows(trends.top_n_lump(c, 10))


def test_conditional_means_and_crosstab(stays, rows):
    got = trends.conditional_means(stays, {"x": "x", "ga": F.when(F.col("g") == "a", 1)})
    assert rows(got) == [(M1, 0.5, 1.0), (M2, 1.0, 1.0)]
    tab = trends.crosstab(stays, "g", "target", [0, 1])
    assert rows(tab) == [("a", None, 2), ("b", 1, None), (None, 1, None)]
    assert sorted(trends.crosstab(stays, "g", "target").columns) == ["0", "1", "g"]


def test_threshold_grid(spark, rows):
    d = spark.createDataFrame([(3, 5), (4, 2), (None, 4)], "a_day_4 int, b_day_2 int")
    got = trends.threshold_grid(d, {"a_day_4": 4, "b_day_2": 2})
    assert rows(got) == [("a_day_4", 3, 3, 2), ("a_day_4", 4, 3, 1)]


def test_calibration_bins(spark, rows):
    d = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.1000001, 1), (1.0, 1)], "s double, target int")
    assert rows(trends.calibration_bins(d, "s")) == [(1, 2, 0.5), (10, 1, 1.0), (2, 1, 1.0)]
    same = spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, target int")
    assert rows(trends.calibration_bins(same, "s")) == [(1, 2, 0.5)]


def test_condition_rates(spark, rows):
    conds = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6)],
                                  "person_id int, condition_concept_id int")
    people = spark.createDataFrame([(1, 1), (2, 0)], "person_id int, imv int")
    names = spark.createDataFrame([(5, "five")], "concept_id int, concept_name string")
    got = trends.condition_rates(conds, people, names, {"imv_rate": "imv"})
    assert [tuple(r) for r in got.collect()] == [(5, "five", 2, 0.5), (6, None, 1, 0.0)]


# --- grouped summary ---------------------------------------------------------

def test_table1(spark, rows):
    d = spark.createDataFrame([(0, 1.0, "x"), (0, 2.0, "y"), (0, None, None), (1, 5.0, "x")],
                              "target int, v double, g string")
    assert rows(summary.table1_continuous(d, "target", ["v"])) == [
        ("v", 0, 2, 1.25, 1.5, 1.75), ("v", 1, 1, 5.0, 5.0, 5.0)]
    assert rows(summary.table1_categorical(d, "target", ["g"])) == [
        ("g", "x", 0, 1, 0.5), ("g", "x", 1, 1, 1.0), ("g", "y", 0, 1, 0.5)]
    kept = summary.table1_categorical(d, "target", ["g"], keep_missing=True)
    assert ("g", "(Missing)", 0, 1, 1 / 3) in rows(kept)


def test_rank_sum_by_hand(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (1, 2.0), (1, 3.0), (1, None)],
                              "target int, v double")
    got = summary.rank_sum(d, "target", ["v"], with_p=True).first()
    # ranks 1, 3, 3 | 3, 5: W = 7 - 6
    assert (got.n_first, got.n_second, got.w) == (3, 2, 1.0)
    assert got.sd == pytest.approx((3 * 2 / 12 * (6 - 24 / 20)) ** 0.5)
    assert got.z == pytest.approx((1 - 3 + 0.5) / got.sd) and 0 < got.p < 1


def test_chi_square(spark):
    d = spark.createDataFrame([(0, "x")] * 10 + [(0, "y")] * 20 + [(1, "x")] * 30
                              + [(1, "y")] * 5 + [(1, None)], "target int, g string")
    got = summary.chi_square(d, "target", ["g"], with_p=True).first()
    n, a, b, c, e = 65, 10, 20, 30, 5
    want = n * (a * e - b * c) ** 2 / ((a + b) * (c + e) * (a + c) * (b + e))
    assert got.statistic == pytest.approx(want) and got.df == 1
    assert got.p == pytest.approx(math.erfc(math.sqrt(want / 2)))


def test_extreme_months(spark):
    d = spark.createDataFrame([(M1, 100, 20, 80, 0.2), (M2, 100, 50, 50, 0.5),
                               (date(2020, 5, 1), 10, 3, 7, 0.3)],
                              "reporting_period date, n long, events long, non_events long, "
                              "rate double")
    got = summary.extreme_months_chisq(d).first()
    assert (got.max_month, got.min_month) == (M2, M1)
    want = 200 * (abs(50 * 80 - 50 * 20) - 100) ** 2 / (100 * 100 * 70 * 130)
    assert got.statistic == pytest.approx(want)
    plain = summary.extreme_months_chisq(d, correct=False).first().statistic
    assert plain > got.statistic
