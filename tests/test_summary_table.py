"""The stacked summary table on small fixtures: gaps, ties, exact tests, empty groups."""

import math

import pytest

from cohortkit.operators import summary


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, x double, f int, c string")


def test_statistics_levels_and_unknown_rows(spark):
    nan = float("nan")
    df = frame(spark, [(0, 1.0, 1, "b"), (0, 2.0, 0, "a"), (0, 4.0, 0, None), (1, 3.0, 1, "b"), (1, nan, 1, "a"),
                       (1, None, None, "z"), (1, 5.0, 1, "z"), (2, 9.0, 1, "q"), (None, 9.0, 1, "q")])
    got = summary.summary_table(df, "g", ["x"], ["f"], ["c"]).orderBy("position", "seq").collect()
    by = {(r.variable, r.level): r for r in got}
    assert set(by) == {("x", None), ("x", "Unknown"), ("f", "1"), ("f", "Unknown"), ("c", "a"), ("c", "b"),
                       ("c", "z"), ("c", "Unknown")}
    x = by["x", None]
    assert (x.n, x.n_0, x.n_1, x.median_0, x.median_1) == (5, 3, 2, 2.0, 4.0) and 0 < x.p < 1
    assert (by["x", "Unknown"].n_0, by["x", "Unknown"].n_1, by["x", "Unknown"].p) == (0, 2, None)
    f = by["f", "1"]
    assert (f.n, f.n_0, f.n_1, f.pct_0, f.pct_1) == (6, 1, 3, pytest.approx(1 / 3), 1.0)
    # all tables with margins 3, 3 and 4, 2: the cell holds 1 to 3 with weights 3, 9, 3
    assert f.p == pytest.approx(6 / 15)
    assert [by["c", v].seq for v in ("a", "b", "z")] == [1, 2, 3]      # two rows each: by name
    assert by["c", "z"].n_0 == 0 and by["c", "z"].pct_0 == 0.0
    assert math.isclose(by["c", "a"].p, by["c", "b"].p)


def test_a_level_called_unknown_keeps_its_test(spark):
    df = frame(spark, [(0, 1.0, 1, "Unknown"), (0, 1.0, 0, "b"), (1, 1.0, 1, "b"), (1, 1.0, 0, None)])
    got = [r for r in summary.summary_table(df, "g", categorical=["c"]).collect() if r.level == "Unknown"]
    assert sorted((r.seq is None, r.p is None) for r in got) == [(False, False), (True, True)]


def test_without_rows(spark):
    df = frame(spark, [(2, 1.0, 1, "a")])
    got = summary.summary_table(df, "g", ["x"], ["f"], ["c"]).collect()
    assert [(r.variable, r.n, r.n_0, r.n_1, r.p) for r in got] == [("x", 0, 0, 0, None)]


def test_frequent_levels_come_first(spark):
    counts = spark.createDataFrame([("v", f"l{i:03}", 1 + (i * 7) % 50) for i in range(300)],
                                   "variable string, level string, n long")
    got = {r.level: r.seq for r in summary.level_order(counts, ["variable"]).collect()}
    want = sorted(counts.collect(), key=lambda r: (-r.n, r.level))
    assert [r.level for r in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 301))
