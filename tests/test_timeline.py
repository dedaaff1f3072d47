from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import checks, timeline


@pytest.fixture
def members(spark, day):
    return spark.createDataFrame([(1, day(0), day(10)), (2, day(0), day(3))],
                                 "person_id long, index_start date, index_end date")


def events(spark, day, *rows):
    return spark.createDataFrame([(p, c, None if d is None else day(d)) for p, c, d in rows],
                                 "person_id long, cid int, dt date")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "concept_id int")


def test_severity(spark, members, day, rows):
    procs = events(spark, day, (1, 10, 0), (1, 10, 0), (1, 99, 2), (1, 10, 11), (1, 10, None),
                   (2, 20, 3))
    obs = events(spark, day, (1, 20, 0), (2, 10, 4))
    got = timeline.severity_by_day(members, [(procs, "cid", "dt"), (obs, "cid", "dt")],
                                   {"imv": ids(spark, 10, 10), "ecmo": ids(spark, 20)})
    assert rows(got) == [(1, 0, 1, 1), (1, 2, 0, 0), (2, 3, 0, 1)]
    assert rows(timeline.early_severity(got)) == [(1, 1, 1)]


def labs(spark, day, members, *rows):
    m = spark.createDataFrame(
        [(i, p, c, v, day(d), datetime(2020, 6, 10 + d, h)) for i, p, c, v, d, h in rows],
        "measurement_id long, person_id long, measurement_concept_id int, value double, "
        "measurement_date date, measurement_datetime timestamp")
    lookup = spark.createDataFrame([(1, "pct"), (2, "pct"), (3, "wbc")],
                                   "concept_id int, measure_name string")
    return timeline.labs_in_stay(m, lookup, members)


def test_lab_sequence_and_first(spark, members, day, rows):
    found = labs(spark, day, members,
                 (5, 1, 1, 0.5, 0, 8), (4, 1, 2, 0.7, 0, 8),     # same time: lower id first
                 (3, 1, 1, 0.1, 10, 1), (2, 1, 1, 9.0, 11, 1),   # last day in, next day out
                 (1, 1, 1, None, 0, 1), (6, 1, 3, 7.0, 1, 5), (7, 2, 3, 8.0, 0, 5),
                 (8, 2, 3, 8.5, 0, 23), (9, 1, 77, 1.0, 0, 0))
    got = timeline.lab_sequence(found)
    assert rows(got, "person_id", "measure_name", "measurement_id", "seq_no") == [
        (1, "pct", 3, 3), (1, "pct", 4, 1), (1, "pct", 5, 2), (1, "wbc", 6, 1),
        (2, "wbc", 7, 1), (2, "wbc", 8, 2)]
    assert rows(timeline.first_value(found, "pct")) == [(1, 0.7)]
    assert rows(timeline.first_value(found, "wbc")) == [(1, 7.0), (2, 8.0)]
    first = got.where("seq_no = 1 and measure_name = 'wbc'").select("person_id", "value")
    assert rows(first) == rows(timeline.first_value(found, "wbc"))


def test_max_band(spark, members, day, rows):
    found = labs(spark, day, members, (1, 1, 1, 0.5, 0, 8), (2, 1, 1, 9.0, 2, 8),
                 (3, 2, 1, 0.5, 0, 1), (4, 2, 2, 0.51, 1, 1))
    assert rows(timeline.early_max_band(found)) == [(1, "low"), (2, "high")]


def test_windows(spark, members, day, rows):
    e = events(spark, day, *[(1, 10, d) for d in (-3, -2, 0, 2, 3, 7, 8)], (1, 10, None),
               (3, 10, 0))
    def found(lo, hi, **kw):
        got = timeline.events_in_window(members, e, "dt", lo, hi, **kw)
        assert got.columns == e.columns
        return sorted((r.dt - day(0)).days for r in got.collect())
    assert found(-2, 7) == [-2, 0, 2, 3, 7]
    assert found(8, None) == [8]
    assert found(0, 2) == [0, 2]
    assert found(None, 0) == [-3, -2, 0]
    assert found(3, F.col("index_end"), bounds=["index_end"]) == [3, 7, 8]


def test_windowed_count(spark, members, day, rows):
    e = events(spark, day, (1, 10, 0), (1, 10, 0), (1, 11, 1), (1, 12, 1), (1, 10, 9), (2, 10, 2))
    got = timeline.windowed_event_count(members, e, ids(spark, 10, 11), "cid", "dt", 0, 7)
    assert rows(got) == [(1, 3), (2, 1)]


def test_first_onset(spark, day, rows):
    e = events(spark, day, (1, 10, 9), (1, 11, 8), (1, 12, 1), (2, 12, 3))
    assert rows(timeline.first_onset(e, [10, 11], "cid", "dt")) == [(1, day(8))]
    assert rows(timeline.first_onset(e, ids(spark, 12), "cid", "dt")) == [(1, day(1)), (2, day(3))]


def person_days(spark, *rows):
    return spark.createDataFrame(list(rows), "person_id long, hospital_day int")


def test_courses(spark, rows):
    # gaps of 1 and 2 stay in a course, a gap of 3 starts the next one
    d = person_days(spark, *[(1, x) for x in (0, 1, 3, 6, 7, 20)], (2, 5))
    courses = timeline.assign_courses(d)
    assert rows(courses) == [(1, 0, 1), (1, 1, 1), (1, 20, 3), (1, 3, 1), (1, 6, 2), (1, 7, 2),
                             (2, 5, 1)]
    durations = timeline.first_course_duration(courses)
    assert rows(durations) == [(1, 3), (2, 0)]
    cohort = spark.createDataFrame([(1, 0), (3, 1)], "person_id long, outcome int")
    assert rows(timeline.course_for_cohort(durations, cohort, ["outcome"])) == [(1, 0, 3)]


def test_episodes(spark, rows):
    d = person_days(spark, *[(1, x) for x in (0, 2, 4, 7, 8)], (2, 0))
    got = timeline.gap_episodes(d)
    # length counts days present, not the span
    assert rows(got) == [(1, 1, 3), (1, 2, 2), (2, 1, 1)]
    assert rows(timeline.long_episodes(got, 2)) == [(1, 2)]


def test_course_quantiles(spark):
    d = spark.createDataFrame([("a", x) for x in (0, 1, 2, 10)] + [("b", 4)],
                              "g string, duration int")
    got = {r.g: r for r in timeline.course_quantiles(d, ["g"]).collect()}
    assert (got["a"].p25, got["a"].p50, got["a"].p75) == (0.75, 1.5, 4.0)
    assert got["b"].p50 == 4.0


def test_checks(spark, day, rows):
    c = spark.createDataFrame([(1, day(-16), day(0)), (2, day(-17), day(0)), (3, day(2), day(0)),
                               (4, day(3), day(0)), (5, None, day(0))],
                              "person_id long, first_positive date, index_start date")
    assert rows(checks.check_window(c), "person_id") == [(2,), (4,)]
    twice = c.union(c.where("person_id = 1"))
    assert rows(checks.check_unique(twice)) == [(6, 5)]
    sites = spark.createDataFrame([(1, 500), (2, 501)], "site int, record_count int")
    assert rows(checks.check_partner_threshold(sites)) == [(1,)]
    routed = spark.createDataFrame([(4, 5), (5, 5), (1, 1), (5, 2)],
                                   "is_enteral_strategy int, is_parenteral_strategy int")
    assert rows(checks.check_rule_coverage(routed)) == [(0.25, 0.75)]
    assert rows(checks.check_rule_coverage(routed.limit(0))) == [(None, None)]
    assert checks.spot_check(sites, "site", 2).count() == 1


def test_concept_listed_twice(spark):
    from cohortkit.operators import timeline

    cohort = spark.createDataFrame([(1, "2020-01-01")], "person_id int, d string").selectExpr(
        "person_id", "date(d) AS index_start")
    events = spark.createDataFrame([(1, 7, "2020-01-02"), (1, 8, "2020-01-02")], "person_id int, c int, d string") \
        .selectExpr("person_id", "c", "date(d) AS day")
    concepts = spark.createDataFrame([(7,), (7,), (8,)], "concept_id int")
    count = lambda **k: timeline.windowed_event_count(cohort, events, concepts, "c", "day", **k).first()["n"]
    assert count() == 3 and count(distinct=True) == 2
