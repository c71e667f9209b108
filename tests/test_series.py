"""Baselines, states and grids: known vectors and invariance to the future."""

import pytest
from pyspark.sql import functions as F

from pressmill.operators import series as S


def bins(spark, values, topic="t"):
    return spark.createDataFrame([(topic, f"{i:04d}", None if v is None else float(v), c) for i, (v, c) in enumerate(values)], "topic string, bin string, x double, n bigint")


def last(spark, history, current, count):
    rows = S.trailing_baseline(bins(spark, [(h, 1) for h in history] + [(current, count)]), "x", "n")
    return rows.orderBy(F.desc("bin")).first()


def test_alert_vectors(spark):
    r = last(spark, [10] * 7, 25, 10)
    assert (r.baseline_mean, r.threshold, r.candidate) == (10, 20, True)
    assert not last(spark, [10] * 7, 25, 9).candidate
    assert last(spark, [10] * 6, 25, 10).threshold is None
    assert last(spark, [10, 10, None, 10, 10, 10, 10], 25, 10).threshold is None
    assert last(spark, [10] * 7, None, 10).threshold is None
    assert not last(spark, [0] * 7, 0, 10).candidate


def test_future_never_changes_the_past(spark):
    values = [(5 + i % 3, 12) for i in range(20)]
    old = S.trailing_baseline(bins(spark, values), "x", "n").where("bin < '0012'")
    new = S.trailing_baseline(bins(spark, values[:12] + [(900, 900)] * 8), "x", "n").where("bin < '0012'")
    key = lambda df: sorted(map(str, df.select("bin", "threshold", "candidate").collect()))
    assert key(old) == key(new)


def test_states_by_precedence(spark):
    grid = spark.createDataFrame([("t", b) for b in "abcde"], "topic string, bin string")
    num = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "d", 1)], "topic string, bin string, n bigint")
    den = spark.createDataFrame([("a", 10), ("b", 0), ("c", 5), ("d", 4)], "bin string, total bigint")
    states = {r.bin: r.state for r in S.aligned(grid, num, den).collect()}
    assert states == {"a": "observed", "b": "unverified_denominator", "c": "missing", "d": "excluded_latest_bin", "e": "missing"}


def test_points_need_one_series_and_success(spark):
    one = '{"status":200,"data":{"timeline":[{"series":"s","data":[{"date":"d1","value":1,"norm":2},{"date":"d1","value":3,"norm":2}]}]}}'
    rows = [("a", one), ("b", one.replace("200", "429")), ("c", '{"status":200,"data":{"timeline":[]}}'), ("d", '{"articles":[]}'), ("e", None), ("f", "nonsense")]
    out = S.points(spark.createDataFrame(rows, "k string, body string"), "body").collect()
    assert {r.k for r in out} == {"a"} and all(r.repeated for r in out)


def test_islands_and_coverage(spark):
    rows = spark.createDataFrame([("t", f"{i}", v) for i, v in enumerate([1, 1, None, 1, None, 1])], "topic string, bin string, n int")
    runs = {(r.first_bin, r.last_bin, r.n_bins, r.open_ended) for r in S.islands(rows, F.col("n").isNotNull()).collect()}
    assert runs == {("0", "1", 2, False), ("3", "3", 1, False), ("5", "5", 1, True)}
    expected = spark.createDataFrame([("t", "a"), ("t", "b")], "topic string, bin string")
    seen = spark.createDataFrame([("t", "b"), ("t", "z")], "topic string, bin string")
    r = S.coverage(expected, seen).first()
    assert (r.n_expected, r.n_observed, r.n_missing, r.n_outside) == (2, 2, 1, 1)


@pytest.mark.parametrize("steps", [1, 4])
def test_preceding_values_need_a_whole_run(spark, steps):
    rows = S.preceding_values(bins(spark, [(1, 1), (None, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]), "x", steps)
    got = {r.bin: r.preceding for r in rows.collect()}
    assert got["0002"] is None and got["0006"] == ",".join(f"{v}.0" for v in (3, 4, 5, 6)[-steps:])
