import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortkit.functions import distributions, ordering
from cohortkit.operators import regression, summary, weighting


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# --- ordering helpers ---------------------------------------------------------

def test_bucketed_row_number_matches_window(spark):
    # one key holds most rows
    df = spark.range(2000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"),
        (F.xxhash64("id") % 50).alias("v"), "id")
    got = ordering.bucketed_row_number(df, ["k"], F.floor(F.col("v") / 7), ["v", "id"], "rn")
    want = df.selectExpr("*", "row_number() over (partition by k order by v, id) as rn")
    assert got.select(want.columns).exceptAll(want.withColumn(
        "rn", F.col("rn").cast("long"))).count() == 0
    assert got.count() == 2000


def test_bucketed_row_number_null_key(spark):
    df = frame(spark, "k string, id int", (None, 1), (None, 2), ("a", 3))
    got = ordering.bucketed_row_number(df, ["k"], F.lit(0), ["id"], "rn")
    assert sorted((r.id, r.rn) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-5, 5) | st.none(), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = frame(spark, "g int, v double", *[(1, None if v is None else v / 4) for v in values])
    probs = (0, 0.1, 0.25, 0.5, 0.75, 1)
    known = [v / 4 for v in values if v is not None]
    for found in (ordering.value_quantiles(df, ["g"], "v", probs, buckets=4),
                  ordering.day_quantiles(df, ["g"], "v", probs)):
        rows = found.collect()
        if not known:
            assert rows == []
            continue
        got = [rows[0][ordering.quantile_label(p)] for p in probs]
        assert got == pytest.approx(np.quantile(known, probs).tolist())
        assert rows[0].n == len(known)


def test_quantiles_without_groups(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    got = ordering.value_quantiles(df, [], "v", (0.25, 0.5)).first()
    assert (got.n, got.p25, got.p50) == (1001, 250.0, 500.0)


# --- distributions -------------------------------------------------------------

def test_distribution_tails():
    assert distributions.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert distributions.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert distributions.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert distributions.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05)
    assert distributions.t_critical(4) == pytest.approx(2.7764451051977987)
    assert distributions.t_critical(30) == pytest.approx(2.0422724563012373)
    assert distributions.t_critical(math.inf) == pytest.approx(1.959963984540054)
    assert distributions.t_two_sided(0.0, 5) == pytest.approx(1.0)


# --- regressions ---------------------------------------------------------------

def lstsq(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = np.sum((y - x @ beta) ** 2) / (len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x)))


@pytest.fixture(scope="module")
def months(spark):
    rng = np.random.default_rng(3)
    rows = [(t, float(0.5 - 0.01 * t + rng.normal(0, 0.05)), int(rng.integers(50, 200)))
            for t in range(28)]
    rows = [(t, y, n, int(rng.binomial(n, min(max(y, 0.05), 0.95)))) for t, y, n in rows]
    return spark.createDataFrame(rows, "t int, y double, n int, events int"), rows


def test_ols_trend(months):
    df, rows = months
    t, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    beta, se = lstsq(np.column_stack([np.ones_like(t), t]), y)
    got = regression.ols_trend(df, "t", "y").first()
    assert (got.intercept, got.slope) == pytest.approx(tuple(beta))
    assert (got.se_intercept, got.se_slope) == pytest.approx(tuple(se))
    assert got.n == 28 and 0 < got.r2 < 1


def test_segmented_equals_one_regression(months):
    df, rows = months
    t, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    early = t <= 5
    x = np.column_stack([np.ones_like(t), early, np.where(early, t, 0), np.where(early, 0, t)])
    beta, se = lstsq(x, y)
    got = regression.segmented_ols(df, "t", ["y"]).first()
    assert (got.intercept, got.early, got.t_early, got.t_late) == pytest.approx(tuple(beta))
    assert (got.se_intercept, got.se_early, got.se_t_early, got.se_t_late) == pytest.approx(
        tuple(se))


def test_segmented_without_early_rows(months):
    df, _ = months
    got = regression.segmented_ols(df.where("t > 5"), "t", ["y"]).first()
    assert got.early is None and got.t_early is None and got.t_late is not None


def newton(x, score, weight):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        h = x.T @ (weight(x @ beta)[:, None] * x)
        beta = beta + np.linalg.solve(h, x.T @ score(x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_poisson_and_logit(months):
    df, rows = months
    t, n, e = (np.array([r[i] for r in rows], float) for i in (0, 2, 3))
    x = np.column_stack([t, np.ones_like(t)])
    for got, (beta, se) in (
            (regression.poisson_trend(df, "t", "events", "n"),
             newton(x, lambda z: e - n * np.exp(z), lambda z: n * np.exp(z))),
            (regression.grouped_logit(df, "t", "events", "n"),
             newton(x, lambda z: e - n / (1 + np.exp(-z)),
                    lambda z: n * np.exp(-z) / (1 + np.exp(-z)) ** 2))):
        rows_ = {r.term: r for r in got.collect()}
        found = [rows_["t"], rows_["(Intercept)"]]
        assert [r.estimate for r in found] == pytest.approx(beta.tolist(), rel=1e-6)
        assert [r.se for r in found] == pytest.approx(se.tolist(), rel=1e-5)


def test_odds_ratio(spark):
    rows = [(1, 1)] * 30 + [(1, 0)] * 70 + [(0, 1)] * 10 + [(0, 0)] * 90
    df = frame(spark, "x int, y int", *rows)
    got = regression.odds_ratio(df, "y", "x").first()
    assert got.odds_ratio == pytest.approx(30 * 90 / (70 * 10)) and got.n == 200
    assert got.se == pytest.approx((1 / 30 + 1 / 70 + 1 / 10 + 1 / 90) ** 0.5)
    doubled = regression.odds_ratio(df.withColumn("w", F.lit(2.0)), "y", "x", "w").first()
    assert doubled.estimate == pytest.approx(got.estimate)
    assert doubled.se == pytest.approx(got.se / 2 ** 0.5)
    empty = regression.odds_ratio(df.where("not (x = 0 and y = 1)"), "y", "x").first()
    assert empty.estimate is None and empty.se is None and empty.n == 190


def test_rubin_pool(spark):
    est = [(1, 0.5, 0.2), (2, 0.7, 0.25), (3, 0.6, 0.2)]
    df = frame(spark, "imputation int, estimate double, se double, n double, outcome string",
               *[(i, q, s, 100.0, "y") for i, q, s in est])
    got = regression.rubin_pool(df, with_ci=True).first()
    q, u = np.mean([e[1] for e in est]), np.mean([e[2] ** 2 for e in est])
    b = np.var([e[1] for e in est], ddof=1)
    total = u + 4 / 3 * b
    lam = 4 / 3 * b / total
    old, com = 2 / lam ** 2, 98
    obs = (com + 1) / (com + 3) * com * (1 - lam)
    assert (got.estimate, got.se, got.df) == pytest.approx(
        (q, total ** 0.5, old * obs / (old + obs)))
    assert got.ci_low < q < got.ci_high
    # identical copies: nothing between them
    same = df.withColumn("estimate", F.lit(0.5)).withColumn("se", F.lit(0.2))
    one = regression.rubin_pool(same).first()
    assert one.se == pytest.approx(0.2) and one.df == pytest.approx(99 / 101 * 98)


# --- weights and balance ---------------------------------------------------------

def test_iptw(spark):
    df = frame(spark, "target int, link double", (1, 0.0), (0, 0.0), (1, -5.0), (0, 5.0),
               (1, -2000.0), (0, 2000.0), (1, None))
    got = [r.weight for r in weighting.iptw(df, "link").collect()]
    assert got[:2] == [2.0, 2.0] and got[2:6] == [10.0] * 4 and got[6] is None


def test_weight_histogram(spark):
    df = frame(spark, "target int, weight double", (1, 1.0), (1, 2.0), (0, 1.5), (0, 1.51), (0, 1.0))
    got = sorted(tuple(r) for r in weighting.weight_histogram(df, 10).collect())
    assert got == [(0, 1, -1), (0, 6, -2), (1, 1, 1), (1, 10, 1)]
    assert weighting.weight_histogram(df.where("weight = 1")).select("bin").distinct().count() == 1


def test_balance(spark):
    t, c = [1.0, 2.0, 4.0], [0.0, 1.0, 1.0, 6.0]
    df = frame(spark, "target int, v double, g string, w double",
               *[(1, v, "a", 1.0) for v in t], *[(0, v, "a" if v else "b", 1.0) for v in c])
    got = {r.variable: r for r in weighting.balance_table(df, "target", ["v"], ["g"]).collect()}
    v = got["v"]
    assert v.smd == pytest.approx((np.mean(t) - np.mean(c)) / np.std(t, ddof=1))
    assert v.variance_ratio == pytest.approx(np.var(t, ddof=1) / np.var(c, ddof=1))
    assert (got["g=a"].mean_treated, got["g=a"].mean_control) == (1.0, 0.75)
    assert got["g=b"].smd == pytest.approx(None) or got["g=b"].smd is None
    same = weighting.balance_table(df, "target", ["v"], ["g"], "w").collect()
    assert {r.variable: r.smd for r in same} == {k: r.smd for k, r in got.items()}
    after = weighting.balance_table(df.where("v < 5"), "target", ["v"], reference=df).first()
    assert after.sd_treated == pytest.approx(np.std(t, ddof=1))


def test_nan_is_missing(spark):
    from cohortkit.operators import summary

    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (0, nan), (0, 3.0), (1, 2.0), (1, nan), (1, None)], "g int, v double")
    clean = df.where("NOT isnan(v)")
    for f in (lambda d: summary.table1_continuous(d, "g", ["v"]), lambda d: summary.rank_sum(d, "g", ["v"])):
        assert sorted(f(df).collect()) == sorted(f(clean).collect())


def test_chi_square_counts_levels_and_groups(spark):
    from cohortkit.operators import summary

    df = spark.createDataFrame([(0, "a")] * 10 + [(0, "b")] * 20 + [(1, "a")] * 20 + [(1, "b")] * 10 + [(1, None)],
                               "g int, v string")
    got = summary.chi_square(df, "g", ["v"]).first()
    assert got["df"] == 1 and abs(got["statistic"] - 60 * (2 * 100 / 900 + 2 * 400 / 900 - 1)) < 1e-9


# --- exact test and profile intervals ----------------------------------------------------

def _table_rows(spark, tables):
    """One group per (a, b, c, d): x and y as 0/1 rows."""
    rows = [(g, x, y) for g, (a, b, c, d) in enumerate(tables)
            for x, y, n in ((1, 1, a), (1, 0, b), (0, 1, c), (0, 0, d)) for _ in range(n)]
    return spark.createDataFrame(rows, "g int, x int, y int")


def test_exact_test_by_counting(spark):
    tables = [(3, 1, 1, 3), (0, 5, 7, 2), (8, 2, 1, 5), (1, 40, 6, 300), (2, 0, 0, 9), (30, 20, 25, 31), (0, 4, 0, 9),
              (12, 1, 5, 0), (5, 1, 12, 0), (0, 12, 1, 5)]

    def by_counting(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        ways = {k: math.comb(row, k) * math.comb(n - row, col - k)
                for k in range(max(0, row + col - n), min(row, col) + 1)}
        return sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values())

    got = {r.g: r for r in summary.exact_2x2(_table_rows(spark, tables), "x", ["y"], ["g"]).collect()}
    for g, (a, b, c, d) in enumerate(tables):
        row, col, n = min(a + b, c + d), min(a + c, b + d), a + b + c + d
        if not row * col:
            assert got[g].test is None and got[g].p_exact is None and got[g].statistic is None
        elif row * col / n < 5:
            assert got[g].test == "exact" and got[g].p_exact == pytest.approx(by_counting(a, b, c, d), rel=1e-9)
        else:
            assert got[g].test == "chi-square" and got[g].p_exact is None and got[g].statistic > 0


def test_exact_test_of_large_margins(spark):
    counts = spark.createDataFrame([(1, 1, 3), (1, 0, 20_000), (0, 1, 40), (0, 0, 900_000)], "x int, y int, n int")
    rows = counts.select("x", "y", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    r = summary.exact_2x2(rows, "x", ["y"]).first()
    # a cell expected to hold 0.93 of 43: near Poisson
    tail = sum(math.exp(-0.9348) * 0.9348 ** k / math.factorial(k) for k in range(3, 40))
    assert r.test == "exact" and r.p_exact == pytest.approx(tail, rel=0.05)
    assert summary.exact_2x2(rows.limit(0), "x", ["y"], ["x"]).count() == 0


def test_profile_interval_is_where_the_likelihood_falls(spark):
    tables = [(8, 12, 30, 150), (1, 30, 2, 400), (500, 1, 300, 9), (0, 4, 3, 9)]
    df = _table_rows(spark, tables)
    got = {r.g: r for r in regression.odds_ratio(df, "y", "x", by=["g"], interval="profile").collect()}
    wald = {r.g: r for r in regression.odds_ratio(df, "y", "x", by=["g"]).collect()}

    def log_likelihood(beta, a, b, c, d):
        lo, hi = -60.0, 60.0
        for _ in range(200):        # the intercept whose fitted events are those observed
            mid = (lo + hi) / 2
            fitted = (a + b) / (1 + math.exp(-mid - beta)) + (c + d) / (1 + math.exp(-mid))
            lo, hi = (mid, hi) if fitted < a + c else (lo, mid)
        p, q = 1 / (1 + math.exp(-lo - beta)), 1 / (1 + math.exp(-lo))
        return a * math.log(p) + b * math.log(1 - p) + c * math.log(q) + d * math.log(1 - q)

    for g, table in enumerate(tables[:3]):
        best = log_likelihood(got[g].estimate, *table)
        for end in (got[g].ci_low, got[g].ci_high):
            assert 2 * (best - log_likelihood(math.log(end), *table)) == pytest.approx(3.841458820694124, abs=1e-5)
        assert got[g].ci_low < got[g].odds_ratio < got[g].ci_high and got[g].estimate == wald[g].estimate
    assert got[3].ci_low is None and got[3].estimate is None
