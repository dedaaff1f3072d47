"""Trend regressions and effect sizes that have a closed form or a built-in fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.functions.distributions import t_p, t_quantile
from cohortkit.operators.summary import two_by_two
from cohortkit.sources.lookups import EARLY_CUT

Z95 = 1.959963984540054
CHI95 = Z95 * Z95       # of one degree of freedom


def _long_y(df: DataFrame, keys: Sequence[str], ys: Sequence[str]) -> DataFrame:
    return (df.select(*keys, *(F.col(y).cast("double").alias(y) for y in ys))
            .unpivot(list(keys), list(ys), "outcome", "_y"))


def ols_trend(df: DataFrame, t: str, ys: Sequence[str] | str) -> DataFrame:
    """Least-squares line of each outcome on t, with standard errors."""
    ys = [ys] if isinstance(ys, str) else list(ys)
    long = _long_y(df, [t], ys)
    fit = long.groupBy("outcome").agg(
        F.regr_count("_y", t).alias("n"), F.regr_slope("_y", t).alias("slope"),
        F.regr_intercept("_y", t).alias("intercept"), F.regr_r2("_y", t).alias("r2"),
        F.regr_sxx("_y", t).alias("sxx"), F.regr_syy("_y", t).alias("syy"),
        F.regr_sxy("_y", t).alias("sxy"), F.regr_avgx("_y", t).alias("mean_t"))
    sxx = F.col("sxx")
    s2 = F.try_divide(F.greatest(F.col("syy") - F.try_divide(F.col("sxy") ** 2, sxx), F.lit(0.0)),
                      F.nullif(F.col("n") - 2, F.lit(0)))
    fit = fit.withColumn("s2", s2)
    return fit.select(
        "outcome", "n", "slope", "intercept", "r2",
        F.sqrt(F.try_divide("s2", sxx)).alias("se_slope"),
        F.sqrt(F.col("s2") * (F.try_divide(F.lit(1.0), F.col("n"))
                            + F.try_divide(F.col("mean_t") ** 2, sxx)))
        .alias("se_intercept"))


def segmented_ols(df: DataFrame, t: str, ys: Sequence[str], cut: int = EARLY_CUT) -> DataFrame:
    """Two lines per outcome, one for t <= cut and one after, as one regression.

    ``intercept`` is the late line at t = 0 and ``early`` the shift of the early
    line from it; all standard errors share one residual variance.
    """
    long = _long_y(df, [t], ys).where(F.col("_y").isNotNull())
    aggs = []
    for name, rows in (("e", F.col(t) <= cut), ("l", F.col(t) > cut)):
        y, x = F.when(rows, F.col("_y")), F.when(rows, F.col(t).cast("double"))
        aggs += [F.regr_count(y, x).alias(f"n_{name}"), F.regr_slope(y, x).alias(f"b_{name}"),
                 F.regr_intercept(y, x).alias(f"a_{name}"), F.regr_sxx(y, x).alias(f"sxx_{name}"),
                 F.regr_syy(y, x).alias(f"syy_{name}"), F.regr_sxy(y, x).alias(f"sxy_{name}"),
                 F.regr_avgx(y, x).alias(f"m_{name}")]
    fit = long.groupBy("outcome").agg(*aggs)

    def col(name):
        return F.col(name)

    def ssr(s):
        return F.greatest(col(f"syy_{s}") - F.try_divide(col(f"sxy_{s}") ** 2, col(f"sxx_{s}")),
                          F.lit(0.0))

    def at_zero(s):
        return F.try_divide(F.lit(1.0), col(f"n_{s}")) + F.try_divide(col(f"m_{s}") ** 2, col(f"sxx_{s}"))

    n = col("n_e") + col("n_l")
    fit = fit.withColumn("s2", F.try_divide(ssr("e") + ssr("l"), F.nullif(n - 4, F.lit(0))))
    s2 = col("s2")
    return fit.select(
        "outcome", n.alias("n"), col("a_l").alias("intercept"),
        (col("a_e") - col("a_l")).alias("early"), col("b_e").alias("t_early"),
        col("b_l").alias("t_late"), F.sqrt(s2 * at_zero("l")).alias("se_intercept"),
        F.sqrt(s2 * (at_zero("e") + at_zero("l"))).alias("se_early"),
        F.sqrt(F.try_divide(s2, col("sxx_e"))).alias("se_t_early"),
        F.sqrt(F.try_divide(s2, col("sxx_l"))).alias("se_t_late"))


def _glr(df: DataFrame, family: str, label: str, features: Sequence[str],
         **options: str) -> DataFrame:
    """Fit a built-in generalised linear model; return its coefficient rows."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    model = GeneralizedLinearRegression(family=family, labelCol=label, featuresCol="_x",
                                        maxIter=50, tol=1e-12, **options).fit(rows)
    summary = model.summary
    values = [*model.coefficients.tolist(), model.intercept]
    errors = list(summary.coefficientStandardErrors)
    out = [(term, float(b), float(se), float(b / se), math.erfc(abs(b / se) / math.sqrt(2)))
           for term, b, se in zip([*features, "(Intercept)"], values, errors)]
    return df.sparkSession.createDataFrame(
        out, "term string, estimate double, se double, statistic double, p double")


def poisson_trend(df: DataFrame, t: str, y: str, exposure: str) -> DataFrame:
    """Poisson regression of a count on t with log(exposure) as offset."""
    rows = df.where(F.col(exposure) > 0).select(
        F.col(t).cast("double").alias(t), F.col(y).cast("double").alias(y),
        F.log(exposure).alias("_offset"))
    return _glr(rows, "poisson", y, [t], link="log", offsetCol="_offset")


def grouped_logit(df: DataFrame, t: str, events: str, n: str) -> DataFrame:
    """Binomial regression of events out of n on t."""
    rows = df.where(F.col(n) > 0).select(
        F.col(t).cast("double").alias(t), (F.col(events) / F.col(n)).alias("_rate"),
        F.col(n).cast("double").alias("_n"))
    return _glr(rows, "binomial", "_rate", [t], link="logit", weightCol="_n")


def _profile_bound(side: int) -> Column:
    """Where the profile likelihood of the log odds ratio falls to the 95 % bound, from cells a to d.

    For a fixed odds ratio the best fit keeps the margins: its cells are a+t, b-t, c-t, d+t for some
    t.  The deviance grows with t on each side, so t is found by bisection, and gives the ratio."""
    a, b, c, d = (F.col(v) for v in "abcd")

    def inside(t: Column) -> Column:
        fitted = ((a, a + t), (b, b - t), (c, c - t), (d, d + t))
        return 2 * sum(o * (F.log(o) - F.log(f)) for o, f in fitted) < CHI95

    def halve(s: Column, _: Column) -> Column:
        mid = (s.near + s.far) / 2
        within = F.coalesce(inside(mid), F.lit(False))
        return F.struct(F.when(within, mid).otherwise(s.near).alias("near"),
                        F.when(within, s.far).otherwise(mid).alias("far"))

    end = F.least(b, c) if side > 0 else -F.least(a, d)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.lit(0.0).alias("near"), end.alias("far")), halve,
                       lambda s: F.log(a + s.near) + F.log(d + s.near) - F.log(b - s.near) - F.log(c - s.near))


def odds_ratio(df: DataFrame, ys: Sequence[str] | str, x: str, weight: str | None = None,
               by: Sequence[str] = (), interval: str = "wald") -> DataFrame:
    """Log odds ratio of each 0/1 outcome on a 0/1 exposure, with a Wald or ``profile`` interval.

    One binary predictor makes the (weighted) logistic fit a 2x2 table.  An
    empty cell gives NULL estimates.
    """
    if interval not in ("wald", "profile"):
        raise ValueError("interval is 'wald' or 'profile'")
    sums = two_by_two(df, [ys] if isinstance(ys, str) else list(ys), x, weight, by)
    full = F.least("a", "b", "c", "d") > 0
    est = F.when(full, F.log(F.col("a")) - F.log("b") - F.log("c") + F.log("d"))
    se = F.sqrt(F.when(full, 1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d")))
    if interval == "wald":
        low, high = est - Z95 * se, est + Z95 * se
    else:
        low, high = F.when(full, _profile_bound(-1)), F.when(full, _profile_bound(1))
    return sums.select(*by, "outcome", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n"),
                       est.alias("estimate"), se.alias("se"), F.exp(est).alias("odds_ratio"),
                       F.exp(low).alias("ci_low"), F.exp(high).alias("ci_high"))


def rubin_pool(estimates: DataFrame, by: Sequence[str] = ("outcome",), est: str = "estimate",
               se: str = "se", n: str | None = "n", n_coef: int = 2,
               with_ci: bool = False) -> DataFrame:
    """Pool estimates over imputations: mean, within + between variance, and df.

    With ``n`` (rows behind each estimate) the df are adjusted for sample size;
    without between-variance (identical imputations) only that part remains.
    """
    size = F.min(n) if n else F.lit(None)
    parts = (estimates.where(F.col(est).isNotNull() & F.col(se).isNotNull()).groupBy(*by)
             .agg(F.count(F.lit(1)).alias("m"), F.avg(est).alias("estimate"),
                  F.avg(F.col(se) * F.col(se)).alias("within"),
                  F.coalesce(F.var_samp(est), F.lit(0.0)).alias("between"),
                  (size.cast("double") - n_coef).alias("_com")))
    extra = (1 + 1 / F.col("m")) * F.col("between")
    total = F.col("within") + extra
    share = F.try_divide(extra, total)
    old = F.try_divide((F.col("m") - 1).cast("double"), share * share)
    com = F.col("_com")
    observed = (com + 1) / (com + 3) * com * (1 - share)
    df = (F.when(old.isNull(), observed).when(observed.isNull(), old)
          .otherwise(old * observed / (old + observed)))
    out = parts.select(*by, "m", "estimate", F.sqrt(total).alias("se"), df.alias("df"),
                       share.alias("lambda"))
    if not with_ci:
        return out
    t = F.try_divide("estimate", "se")
    half = t_quantile(F.col("df")) * F.col("se")
    return out.select("*", t.alias("statistic"), t_p(t, F.col("df")).alias("p"),
                      (F.col("estimate") - half).alias("ci_low"),
                      (F.col("estimate") + half).alias("ci_high"))
