"""Grouped summary table: quantiles, level counts and group comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortkit.functions.distributions import chi_square_p, normal_p
from cohortkit.functions.expressions import flag
from cohortkit.functions.ordering import (bucketed_row_number, cumulative_counts, known_number,
                                          null_safe_join, value_quantiles)
from cohortkit.session import checkpoint

MISSING = "(Missing)"


def table1_continuous(df: DataFrame, by: str, cols: Sequence[str], buckets: int = 64) -> DataFrame:
    """Per variable and group: known values, median and quartiles (all exact)."""
    long = df.select(by, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(
        [by], list(cols), "variable", "_value")
    return value_quantiles(long, ["variable", by], "_value", (0.25, 0.5, 0.75), buckets).select(
        "variable", by, "n", "p25", F.col("p50").alias("median"), "p75")


def table1_categorical(df: DataFrame, by: str, cols: Sequence[str],
                       keep_missing: bool = False) -> DataFrame:
    """Per variable, level and group: rows and their share of the group's known rows.

    Missing values are left out, or counted as a level with ``keep_missing``.
    Unpivoted before grouping: however many columns, the map-side table has one
    entry per level and group, which is all that is shuffled.
    """
    long = df.select(by, *(F.col(c).cast("string").alias(c) for c in cols)).unpivot(
        [by], list(cols), "variable", "level")
    long = (long.fillna(MISSING, ["level"]) if keep_missing
            else long.where(F.col("level").isNotNull()))
    counts = long.groupBy("variable", "level", by).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("variable", by))
    return counts.withColumn("pct", F.col("n") / whole)


def rank_sum(df: DataFrame, by: str, cols: Sequence[str], levels: Sequence = (0, 1),
             buckets: int = 64, with_p: bool = False) -> DataFrame:
    """Wilcoxon rank-sum of the first level against the second, for each column.

    W is the rank sum of the first group less its minimum; z carries the tie and
    continuity corrections.  Ranks come from value counts, so no task sorts a
    whole column.  NaN counts as missing.
    """
    first, second = levels
    long = df.where(F.col(by).isin(first, second)).select(
        flag(F.col(by) == first).alias("_first"),
        *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(
        ["_first"], list(cols), "variable", "_value")
    freq = checkpoint(long.where(known_number("_value")).groupBy("variable", "_value").agg(
        F.count(F.lit(1)).alias("t"), F.sum("_first").alias("t1")))
    ranked = cumulative_counts(freq, ["variable"], "_value", ["t"], buckets)
    middle = F.col("cum_t") - F.col("t") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    sums = ranked.groupBy("variable").agg(
        F.sum("t").alias("n"), F.sum("t1").alias("n1"), F.sum(F.col("t1") * middle).alias("ranks"),
        F.sum(t * t * t - t).alias("ties"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    out = sums.select(
        "variable", F.col("n1").alias("n_first"), (F.col("n") - F.col("n1")).alias("n_second"),
        (F.col("ranks") - n1 * (n1 + 1) / 2).alias("w"),
        F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))).alias("sd"),
        (n1 * n2 / 2).alias("_expected"))
    shift = F.col("w") - F.col("_expected")
    z = F.try_divide(shift - F.signum(shift) * 0.5, F.col("sd"))
    out = out.withColumn("z", z).drop("_expected")
    return out.withColumn("p", normal_p(F.col("z"))) if with_p else out


def chi_square(df: DataFrame, by: str, cols: Sequence[str], with_p: bool = False) -> DataFrame:
    """Pearson's chi-square of each column against the groups, without correction.

    Missing values are left out.  df = (levels - 1) * (groups - 1).
    """
    # one row per level and group; sums by level and by group join back, so that no task
    # holds all levels of a column
    cells = table1_categorical(df, by, cols).drop("pct")
    groups = cells.groupBy("variable", by).agg(F.sum("n").alias("_g"))
    levels = cells.groupBy("variable", "level").agg(F.sum("n").alias("_l"))
    table = null_safe_join(null_safe_join(cells, groups, ["variable", by]), levels, ["variable", "level"])
    # sum (o-e)^2/e = N * (sum o^2 / (row * col) - 1): empty cells add nothing
    share = F.col("n") * F.col("n").cast("double") / (F.col("_g").cast("double") * F.col("_l"))
    sizes = groups.groupBy("variable").agg(F.sum("_g").alias("n_all"), F.count(by).alias("n_groups")).join(
        levels.groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels")), "variable")
    out = table.groupBy("variable").agg(F.sum(share).alias("_shares")).join(sizes, "variable").select(
        "variable", (F.col("n_all") * (F.col("_shares") - 1)).alias("statistic"),
        ((F.col("n_levels") - 1) * (F.col("n_groups") - 1)).cast("int").alias("df"))
    return out.withColumn("p", chi_square_p(F.col("statistic"), F.col("df"))) if with_p else out


def two_by_two(df: DataFrame, ys: Sequence[str], x: str, weight: str | None = None,
               by: Sequence[str] = ()) -> DataFrame:
    """Per 0/1 outcome (and group), the (weighted) rows of each cell against a 0/1 column.

    a: both 1, b: only ``x``, c: only the outcome, d: neither.  Folded before the unpivot, so the
    shuffle carries a row per combination of values."""
    w = F.col(weight) if weight else F.lit(1)
    cells = df.withColumn("_w", w).groupBy(*by, x, *ys).agg(F.sum("_w").alias("_w"))
    long = cells.unpivot([*by, x, "_w"], list(ys), "outcome", "_y")
    cell = lambda a, b: F.coalesce(
        F.sum(F.when((F.col(x) == a) & (F.col("_y") == b), F.col("_w"))), F.lit(0)).cast("double")
    return long.groupBy(*by, "outcome").agg(
        cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))


#: Beyond this count in a cell that is expected to hold under 5, probabilities are under 1e-300.
SUPPORT = 1000


def _exact_p(k: Column, row: Column, col: Column, n: Column) -> Column:
    """Two-sided exact p of a 2x2 table: all tables with its margins that are no likelier than it.

    ``row`` and ``col`` are the smaller margins and ``k`` the cell of both, so the cell runs from 0;
    each probability follows from the one before, relative to that of 0."""
    grow = lambda w, j: w * (row - j + 1) * (col - j + 1) / (j * (n - row - col + j))
    places = lambda m: F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(SUPPORT + 1)), F.lit(1)).cast("int"))
    own = F.aggregate(places(k), F.lit(1.0), lambda w, j: F.when(j <= k, grow(w, j)).otherwise(w))
    bar = own * (1 + 1e-7)
    first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all"),
                     F.when(bar >= 1, 1.0).otherwise(0.0).alias("tail"))

    def add(s: Column, j: Column) -> Column:
        w = grow(s.w, j)
        return F.struct(w.alias("w"), (s["all"] + w).alias("all"),
                        (s.tail + F.when(w <= bar, w).otherwise(0.0)).alias("tail"))

    return F.aggregate(places(F.least(row, col)), first, add, lambda s: F.least(s.tail / s["all"], F.lit(1.0)))


def exact_2x2(df: DataFrame, by: str, cols: Sequence[str], within: Sequence[str] = (),
              least: float = 5.0) -> DataFrame:
    """Per 0/1 column (and group of ``within``): chi-square against a 0/1 group, or the exact test.

    Fisher's exact test takes the place of chi-square where an expected count is under ``least``.
    Rows with a missing value are left out; a table with an empty margin has no test (NULL).
    """
    cells = two_by_two(df, cols, by, by=within)
    a, b, c, d = (F.col(v) for v in "abcd")
    n, row, col = a + b + c + d, F.least(a + b, c + d), F.least(a + c, b + d)
    k = (F.when(a + b <= c + d, F.when(a + c <= b + d, a).otherwise(b))
         .otherwise(F.when(a + c <= b + d, c).otherwise(d)))
    expected = F.when((row > 0) & (col > 0), row * col / n)
    exact = expected < least
    gap = a * d - b * c
    return cells.select(
        *within, F.col("outcome").alias("variable"), n.cast("long").alias("n"), expected.alias("least_expected"),
        F.when(exact, "exact").when(expected.isNotNull(), "chi-square").alias("test"),
        F.when(~exact, n * gap * gap / ((a + b) * (c + d) * (a + c) * (b + d))).alias("statistic"),
        F.when(exact, _exact_p(k, row, col, n)).alias("p_exact"))


def level_order(counts: DataFrame, keys: Sequence[str], level: str = "level", n: str = "n",
                name: str = "seq") -> DataFrame:
    """Number the levels of a column from the most frequent on, ties by name.

    ``counts`` holds one row per key and level.  Numbered inside powers of two of the count and
    shifted, so a column with very many levels is not sorted in one task."""
    ranked = counts.withColumn("_down", -F.col(n))
    return bucketed_row_number(ranked, keys, -F.floor(F.log2(n)), ["_down", level], name).drop("_down")


def summary_table(df: DataFrame, by: str, continuous: Sequence[str] = (), dichotomous: Sequence[str] = (),
                  categorical: Sequence[str] = (), levels: Sequence = (0, 1)) -> DataFrame:
    """One table of all variables: known rows, statistics per group, levels, unknown rows and p.

    ``continuous`` columns get a row with quartiles and the rank-sum p; 0/1 ``dichotomous`` columns the
    row of value 1 with the exact 2x2 p where an expected count is under 5, else chi-square's;
    ``categorical`` columns a row per level, most frequent first, with chi-square's p.  ``n`` counts a variable's
    known rows; a variable with missing values gets a last row with level Unknown.  Rows of other groups
    are left out.  Without any rows only continuous variables are listed, with n 0.
    """
    rows = checkpoint(df.where(F.col(by).isin(*levels)).select(
        flag(F.col(by) == levels[1]).alias("_arm"), *(F.col(c).cast("double").alias(c) for c in continuous),
        *(F.col(c).cast("int").alias(c) for c in dichotomous), *(F.col(c).cast("string").alias(c) for c in categorical)))

    def sides(table: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
        return table.groupBy(*keys).agg(*(F.max(F.when(F.col("_arm") == arm, F.col(c))).alias(f"{c}_{arm}")
                                          for c in cols for arm in (0, 1)))

    listed = [*continuous, *dichotomous, *categorical]
    unknown = rows.groupBy("_arm").agg(*(
        F.count_if(~known_number(c) if c in continuous else F.col(c).isNull()).alias(c) for c in listed))
    missing = sides(unknown.unpivot(["_arm"], listed, "variable", "n"), ["variable"], ["n"])
    parts = [missing.where((F.col("n_0") > 0) | (F.col("n_1") > 0))
             .withColumns({"level": F.lit("Unknown"), "seq": F.lit(None).cast("int")})]
    tests = []
    if continuous:
        parts.append(sides(table1_continuous(rows, "_arm", continuous), ["variable"],
                           ["n", "p25", "median", "p75"]).withColumn("seq", F.lit(0)))
        tests.append(rank_sum(rows, "_arm", continuous, with_p=True).select("variable", "p"))
    if dichotomous or categorical:
        cells = table1_categorical(rows, "_arm", [*dichotomous, *categorical])
        table = sides(cells, ["variable", "level"], ["n", "pct"]).fillna(0)
        order = level_order(cells.groupBy("variable", "level").agg(F.sum("n").alias("n")), ["variable"])
        parts.append(table.join(order.select("variable", "level", "seq"), ["variable", "level"])
                     .where(~F.col("variable").isin(list(dichotomous)) | (F.col("level") == "1")))
    if dichotomous:
        exact = exact_2x2(rows, "_arm", dichotomous)
        tests.append(exact.select("variable", F.coalesce(
            "p_exact", chi_square_p(F.col("statistic"), F.lit(1))).alias("p")))
    if categorical:
        chi = chi_square(rows, "_arm", categorical, with_p=True)
        tests.append(chi.select("variable", F.when(F.col("df") > 0, F.col("p")).alias("p")))
    known = rows.agg(*(F.count_if(known_number(c) if c in continuous else F.col(c).isNotNull()).alias(c)
                       for c in listed)).unpivot([], listed, "variable", "n")
    places = df.sparkSession.createDataFrame(list(enumerate(listed)), "position int, variable string")
    body = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if continuous:
        # a variable without a known value still has its row
        bare = places.where(F.col("variable").isin(list(continuous))).select("variable", F.lit(0).alias("seq"))
        body = bare.join(body, ["variable", "seq"], "full")
    empty = {c: F.lit(None).cast(kind) for c, kind in (
        ("level", "string"), *((f"{c}_{arm}", "double") for c in ("pct", "p25", "median", "p75") for arm in (0, 1)))
        if c not in body.columns}
    body = body.withColumns(empty) if empty else body
    return (body.join(places, "variable").join(known, "variable")
            .join(reduce(DataFrame.unionByName, tests), "variable", "left")
            .select("position", "variable", F.col("seq").cast("int").alias("seq"), "level", "n", *(
                c if not c.startswith("n_") else F.coalesce(c, F.lit(0)).alias(c)
                for c in (f"{stat}_{arm}" for stat in ("n", "pct", "p25", "median", "p75") for arm in (0, 1))),
                F.when(F.col("level").isNull() | (F.col("level") != "Unknown") | F.col("seq").isNotNull(),
                       F.col("p")).alias("p")))


def extreme_months_chisq(stats: DataFrame, month: str = "reporting_period",
                         correct: bool = True, with_p: bool = False) -> DataFrame:
    """The months with the highest and lowest rate, and the 2x2 chi-square between them.

    Yates' correction is on by default; equal rates are settled by the earliest
    month for the highest and the latest for the lowest.
    """
    at = F.struct("events", "non_events", "rate", month)
    days = F.datediff(F.col(month), F.lit("1970-01-01").cast("date"))
    hi = F.max_by(at, F.struct("rate", -days)).alias("hi")
    lo = F.min_by(at, F.struct("rate", -days)).alias("lo")
    a, b = F.col("hi.events").cast("double"), F.col("hi.non_events").cast("double")
    c, d = F.col("lo.events").cast("double"), F.col("lo.non_events").cast("double")
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    if correct:
        gap = gap - F.least(n / 2, gap)
    stat = F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))
    out = stats.agg(hi, lo).select(
        F.col(f"hi.{month}").alias("max_month"), F.col("hi.rate").alias("max_rate"),
        F.col(f"lo.{month}").alias("min_month"), F.col("lo.rate").alias("min_rate"),
        stat.alias("statistic"))
    return out.withColumn("p", chi_square_p(F.col("statistic"), F.lit(1))) if with_p else out
