"""Effect analyses: adjusted models, weighting, matching, matching after imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from cohortkit.functions.expressions import logistic, month_index
from cohortkit.functions.ordering import known_number
from cohortkit.operators.gam import GamFit, gam_logit
from cohortkit.operators.impute import impute_chained, impute_mean
from cohortkit.operators.matching import complete_cases, propensity_match
from cohortkit.operators.regression import odds_ratio, rubin_pool
from cohortkit.operators.weighting import balance_table, iptw
from cohortkit.session import checkpoint

EARLY = ("early_imv", "early_ecmo", "early_vasopressor_use", "early_trauma_flag",
         "early_major_procedure")
OUTCOMES = ("hospital_mortality", "long_imv", "late_antibiotic_exposure", "late_cdad")
#: Filled copies that are matched at the same time.
AT_ONCE = 5


def model_frame(df: DataFrame, origin: tuple[int, int] | None = None) -> DataFrame:
    """The analysis frame with its month as an index and missing gender as a level."""
    month = (month_index(F.col("reporting_period"), origin) if origin
             else month_index(F.col("reporting_period")))
    return df.withColumn("month", month).fillna({"gender_concept_name": "(Missing)"})


def exposure_model(df: DataFrame, extra_factors: Sequence[str] = (),
                   extra_random: Sequence[str] = (), y: str = "target",
                   reference: Mapping[str, object] | None = None) -> GamFit:
    """Adjusted model of the exposure: smooth age and comorbidity, month and site effects.

    ``extra_factors`` adds for example the procalcitonin group, ``extra_random``
    the region; ``reference`` names reference levels.
    """
    return gam_logit(df, y, linear=EARLY, factors=["gender_concept_name", *extra_factors],
                     smooth=["age", "CCI"], random=["month", "data_partner_id", *extra_random],
                     reference=reference)


def weighted_effects(df: DataFrame, outcomes: Sequence[str] = OUTCOMES[:3],
                     cap: float = 10.0) -> DataFrame:
    """Outcome odds ratios under capped inverse-probability weights."""
    fit = exposure_model(df)
    weighted = iptw(fit.predict(df), "link", cap=cap)
    return odds_ratio(weighted, outcomes, "target", "weight")


@dataclass
class Matched:
    data: DataFrame
    fit: GamFit


def match_on_gam(df: DataFrame, smooth: Sequence[str] = ("age", "CCI"), treat: str = "target",
                 caliper: float | None = None, keep: Sequence[str] = OUTCOMES) -> Matched:
    """One-to-one matching on the fitted probability of exposure."""
    used = [*EARLY, "obesity", "smoker"]
    cols = list(dict.fromkeys(["person_id", treat, "month", "race_ethnicity", *used, *smooth,
                               *keep]))
    # read by the fit and by the matching; also keeps long derived-column plans
    # from being analysed again and again (constraint inference grows fast)
    rows = checkpoint(complete_cases(df, cols))
    fit = gam_logit(rows, treat, linear=used, factors=["month", "race_ethnicity"], smooth=smooth)
    scored = fit.predict(rows).withColumn("score", logistic(F.col("link")))
    return Matched(propensity_match(scored, "score", treat, caliper=caliper), fit)


def matched_effects(df: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """Outcome odds ratios in matched data."""
    return odds_ratio(match_on_gam(df, keep=outcomes).data, outcomes, "target")


def imputed_matched_effects(df: DataFrame, method: str = "chained", treat: str = "target",
                            outcomes: Sequence[str] = OUTCOMES, m: int = 5, iters: int = 5,
                            incomplete: Sequence[str] = ("bmi", "wbc"), seed: int = 0,
                            ) -> tuple[DataFrame, DataFrame]:
    """Pooled odds ratios and balance after imputing, matching within each copy, and pooling.

    Chained equations fill every incomplete column of the frame, not only ``incomplete``, and keep all rows.
    With mean imputation the copies are identical, so one stands for all and the
    between-copy variance is zero.
    """
    numeric = list(dict.fromkeys([*EARLY, "obesity", "smoker", "age", "CCI", treat, *outcomes]))
    # read by the imputation, by every match and as the reference of every balance
    base = checkpoint(df.select("person_id", "month", "race_ethnicity", *numeric, *incomplete))
    if method == "mean":
        copies = [(1, checkpoint(impute_mean(base, incomplete)))]
    elif method == "chained":
        levels = ("month", "race_ethnicity")
        gaps = base.agg(*(F.count_if(~known_number(c)).alias(c) for c in numeric),
                        *(F.count_if(F.col(c).isNull()).alias(c) for c in levels)).first()
        split = lambda cols, gap: [c for c in cols if bool(gaps[c]) == gap]
        stacked = impute_chained(base, [*incomplete, *split(numeric, True)], predictors=split(numeric, False),
                                 factors=split(levels, False), categorical=split(levels, True),
                                 m=m, iters=iters, seed=seed)
        copies = [(i, stacked.where(F.col("imputation") == i).drop("imputation"))
                  for i in range(1, m + 1)]
    else:
        raise ValueError("method is 'mean' or 'chained'")

    def match(copy: DataFrame) -> DataFrame:
        return checkpoint(match_on_gam(copy, ["age", "CCI", "wbc"], treat, keep=outcomes).data)

    # a match is many short jobs that leave cores free, and no copy needs another's
    with ThreadPoolExecutor(min(AT_ONCE, len(copies))) as pool:
        # wrapped one by one: each thread has job properties of its own
        started = [pool.submit(inheritable_thread_target(df.sparkSession)(match), copy) for _, copy in copies]
        matches = [x.result() for x in started]
    effects, balance = [], []
    for (i, copy), kept in zip(copies, matches):
        effects.append(odds_ratio(kept, outcomes, treat).withColumn("imputation", F.lit(i)))
        balance.append(balance_table(kept, treat, ["age", "CCI", "wbc"],
                                     [*EARLY, "obesity", "smoker", "race_ethnicity"],
                                     reference=copy).withColumn("imputation", F.lit(i)))
    pooled = rubin_pool(reduce(DataFrame.unionByName, effects), with_ci=True)
    return pooled, reduce(DataFrame.unionByName, balance)
