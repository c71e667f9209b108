"""Queries over count series: hourly events on a 720-hour grid, daily orders on a calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators import series as S
from pressmill.tables import table

FIRST, BINS = "2024-01-01 00:00:00", 720
FIRST_DAY, DAYS = "1995-01-01 00:00:00", 2404


def _hourly(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expected grid, counts per event type and hour, all events per hour."""
    events = table(spark, folder, "events").select("event_type", "ts")
    numerator = S.counts(events, "event_type", "ts", "hour")
    denominator = numerator.groupBy("bin").agg(F.sum("n").alias("total"))
    return S.grid(numerator.select("topic").distinct(), FIRST, "HOUR", BINS), numerator, denominator


def _aligned(spark, folder: str) -> DataFrame:
    return S.aligned(*_hourly(spark, folder))


_SQL_ALIGNED = f"""
numerator AS (SELECT event_type AS topic, strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') AS bin, count(*) AS n FROM events GROUP BY 1, 2),
denominator AS (SELECT bin, sum(n)::BIGINT AS total FROM numerator GROUP BY 1),
topics AS (SELECT DISTINCT topic FROM numerator),
grid AS (SELECT topic, strftime(TIMESTAMP '{FIRST}' + to_hours(CAST(h AS INTEGER)), '%Y%m%d%H%M%S') AS bin FROM topics, range({BINS}) AS r(h)),
sparse AS (SELECT g.topic, g.bin, n, total, max(CASE WHEN n IS NOT NULL OR total IS NOT NULL THEN g.bin END) OVER (PARTITION BY g.topic) AS latest
  FROM grid g LEFT JOIN numerator USING (topic, bin) LEFT JOIN denominator d ON g.bin = d.bin),
stated AS (SELECT topic, bin, n, total, CASE WHEN n IS NULL OR total IS NULL THEN 'missing' WHEN total <= 0 THEN 'unverified_denominator'
  WHEN bin = latest THEN 'excluded_latest_bin' ELSE 'observed' END AS state FROM sparse),
aligned AS (SELECT *, CASE WHEN state = 'observed' THEN n * 10000.0 / total END::DOUBLE AS per_10k FROM stated)
"""


def _sql_baseline(source: str, value: str, least: int, floor: float) -> str:
    return f"""
framed AS (SELECT *, count({value}) OVER w AS k, avg({value}) OVER w AS mu, stddev_samp({value}) OVER w AS sd, string_agg(bin, ',' ORDER BY bin) OVER w AS bins
  FROM {source} WINDOW w AS (PARTITION BY topic ORDER BY bin ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
based AS (SELECT *, k = 7 AND {value} IS NOT NULL AS whole FROM framed),
judged AS (SELECT topic, bin, state, n, total, per_10k, raw, CASE WHEN whole THEN mu END AS baseline_mean, CASE WHEN whole THEN sd END AS baseline_sd,
  CASE WHEN whole THEN bins END AS baseline_bins, CASE WHEN whole THEN round(greatest(mu * 2, mu + sd * 3, mu + {floor}), 9) END AS threshold FROM based),
alerts AS (SELECT *, n >= {least} AND round({value}, 9) > threshold AS candidate FROM judged)
"""


def series_trailing_baseline(spark, folder: str, floor: float = 2.0, least_count: int = 10) -> DataFrame:
    """All grid rows with state, share of all events, trailing baseline, threshold and candidate flag."""
    rows = S.trailing_baseline(_aligned(spark, folder), "per_10k", "n", floor, least_count)
    return rows.select(
        "topic", "bin", "state", F.col("n").alias("article_count"), F.col("total").alias("all_count"), F.round("per_10k", 6).alias("per_10k"), F.round("baseline_mean", 6).alias("baseline_mean"),
        F.round("baseline_sd", 6).alias("baseline_sd"), F.round("threshold", 6).alias("threshold"), F.round("fold", 6).alias("fold"), "baseline_bins", "candidate",
    )


def _raw(spark, folder: str, floor: float = 10.0, least_count: int = 10) -> DataFrame:
    rows = _aligned(spark, folder).withColumn("raw", F.when(F.col("state") != "excluded_latest_bin", F.col("n").cast("double")))
    rows = S.trailing_baseline(rows, "raw", "n", floor, least_count)
    return rows.withColumn("ratio", F.try_divide("raw", "threshold"))


def series_raw_baseline(spark, folder: str) -> DataFrame:
    """The same on counts themselves, with the ratio to the threshold."""
    return _raw(spark, folder).select("topic", "bin", "state", F.col("n").alias("article_count"), F.round("baseline_mean", 6).alias("baseline_mean"), F.round("threshold", 6).alias("threshold"), F.round("ratio", 6).alias("ratio"), "candidate")


def series_preceding_values(spark, folder: str) -> DataFrame:
    """The four counts before each hour, null unless all four hours have one."""
    return S.preceding_values(_aligned(spark, folder), "n", 4).select("topic", "bin", F.col("n").alias("article_count"), "preceding")


def series_adjacent_deltas(spark, folder: str) -> DataFrame:
    """How often which gap lies between observed hours."""
    events = table(spark, folder, "events")
    hours = events.select(F.col("event_type").alias("topic"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("moment")).distinct()
    return S.adjacent_deltas(hours, "moment")


def _order_days(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("topic"), "o_orderdate")
    days = S.counts(orders, "topic", "o_orderdate", "day")
    return S.grid(days.select("topic").distinct(), FIRST_DAY, "DAY", DAYS), days


def series_gap_islands(spark, folder: str) -> DataFrame:
    """Runs of calendar days with orders, per order status, on the days 1995-01-01 to 2001-07-31; ``series_gap_islands_all`` has every day of the table."""
    expected, days = _order_days(spark, folder)
    return S.islands(expected.join(days, ["topic", "bin"], "left"), F.col("n").isNotNull())


def series_gap_islands_all(spark, folder: str) -> DataFrame:
    """Runs of calendar days with orders, per order status, on every day from the table's first order to its last."""
    _, days = _order_days(spark, folder)
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    span = table(spark, folder, "orders").agg(F.min(day).alias("low"), F.max(day).alias("high")).where("low is not null")
    moments = span.select(F.explode(F.sequence("low", "high", F.expr("INTERVAL '1' DAY"))).alias("moment")).select(S.label_of(F.col("moment")).alias("bin"))
    expected = days.select("topic").distinct().crossJoin(moments)
    return S.islands(expected.join(days, ["topic", "bin"], "left"), F.col("n").isNotNull())


def coverage_inventory(spark, folder: str) -> DataFrame:
    """Calendar coverage of orders per status."""
    return S.coverage(*_order_days(spark, folder))


def series_normalisation_checks(spark, folder: str) -> DataFrame:
    """Per type: whether the percentage it states, six decimals of it and three for clicks, is that of its counts; common bins, failed checks."""
    _, numerator, denominator = _hourly(spark, folder)
    norms = denominator.withColumnRenamed("total", "norm")
    exact = F.col("n") * 100.0 / F.col("norm")
    rows = numerator.join(norms, "bin").withColumn("percent", F.when(F.col("topic") == "click", F.round(exact, 3)).otherwise(F.round(exact, 6))).where("norm > 0")
    error = F.max(F.abs(F.col("percent") - F.col("n") * 100.0 / F.col("norm")))
    by_topic = rows.groupBy("topic").agg(F.count("*").alias("n_bins"), error.alias("error"), F.every(F.col("n") <= F.col("norm")).alias("within"))
    failed = F.array_compact(F.array(F.when(~F.coalesce(F.col("error") <= 1e-5, F.lit(False)), "percent differs"), F.when(~F.col("within"), "count above norm"), F.when(F.col("n_bins") < 100, "few bins")))
    return by_topic.select("topic", "n_bins", (F.col("error") <= 1e-5).alias("percent_agrees"), "within", F.concat_ws("; ", failed).alias("failed"), (F.size(failed) == 0).alias("verified"))


def series_numerator_failures(spark, folder: str) -> DataFrame:
    """Hours of clicks whose count the hour's views, taken as denominator, cannot hold."""
    _, numerator, _ = _hourly(spark, folder)
    clicks = numerator.where("topic = 'click'").select("bin", "n", F.col("n").alias("norm"))
    views = numerator.where("topic = 'view'").select("bin", F.col("n").alias("total"), F.col("n").alias("total_norm"))
    return S.numerator_failures(clicks, views).select("bin", "n", "total", "reason")


def _hourly_alerts(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows judged by share and by raw count of an hour, every bin counted 40-fold in each type's first hour of a day, which makes alerts."""
    expected, numerator, _ = _hourly(spark, folder)
    burst = F.when(F.substring("bin", 9, 2) == "00", 40).otherwise(1)
    numerator = numerator.withColumn("n", F.col("n") * F.when(F.col("topic") != "view", burst).otherwise(1))
    rows = S.aligned(expected, numerator, numerator.groupBy("bin").agg(F.sum("n").alias("total"))).withColumn("raw", F.when(F.col("state") != "excluded_latest_bin", F.col("n").cast("double")))
    judged = lambda value, floor: S.trailing_baseline(rows, value, "n", floor).withColumn("ratio", F.round(F.try_divide(value, "threshold"), 6))
    return judged("per_10k", 2.0), judged("raw", 10.0)


def series_best_alert(spark, folder: str) -> DataFrame:
    """Each type's strongest alert: by its share of the hour, or else, as normalisation isn't verified, by its count."""
    shares, raw = _hourly_alerts(spark, folder)
    return S.chosen_alert(shares, raw, verified=False)


def series_requests(spark, folder: str) -> DataFrame:
    """Every type and day a request was due for, with the status of the saved response; days of the 13th failed, those of the 14th were never asked."""
    _, numerator, _ = _hourly(spark, folder)
    days = numerator.select("topic", F.substring("bin", 1, 8).alias("day")).distinct().select(F.concat_ws("/", "topic", "day").alias("request"), "topic", "day")
    saved = days.where("not day like '%14'").select("request", F.when(F.col("day").like("%13"), 429).otherwise(200).alias("status"))
    return S.collected(days, saved, "request").groupBy("topic", "status").agg(F.count("*").alias("n_requests"))


def series_norm_failures(spark, folder: str) -> DataFrame:
    """Hours whose stated norm differs between the types; purchases of the 7th hour state one too many."""
    _, numerator, denominator = _hourly(spark, folder)
    wrong = F.when((F.col("topic") == "purchase") & (F.substring("bin", 9, 2) == "07"), 1).otherwise(0)
    return S.norm_failures(numerator.join(denominator, "bin").select("topic", "bin", (F.col("total") + wrong).alias("norm")))


def series_rollup_vs_daily(spark, folder: str) -> DataFrame:
    """Hourly counts rolled up to days against counts by day."""
    events = table(spark, folder, "events")
    hourly = S.counts(events, "event_type", "ts", "hour").groupBy("topic", F.substring("bin", 1, 8).alias("day")).agg(F.sum("n").alias("n_rolled"), F.count("*").alias("n_hours"))
    daily = events.groupBy(F.col("event_type").alias("topic"), F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n_daily"))
    return hourly.join(daily, ["topic", "day"], "full").select("topic", "day", "n_hours", "n_rolled", "n_daily", (F.col("n_rolled") == F.col("n_daily")).alias("agrees"))


def series_points_from_json(spark, folder: str) -> DataFrame:
    """Points read back from one JSON snapshot per type and day; snapshots with a failing status give none."""
    _, numerator, denominator = _hourly(spark, folder)
    rows = numerator.join(denominator, "bin").withColumn("day", F.substring("bin", 1, 8))
    point = F.struct(F.col("bin").alias("date"), F.col("n").alias("value"), F.col("total").alias("norm"))
    days = rows.groupBy("topic", "day").agg(F.collect_list(point).alias("data"))  # 24 at most
    status = F.when(F.substring("day", 7, 2) == "13", 429).otherwise(200)
    body = F.to_json(F.struct(status.alias("status"), F.struct(F.array(F.struct(F.col("topic").alias("series"), F.col("data"))).alias("timeline")).alias("data")))
    return S.points(days.select("topic", "day", body.alias("body")), "body").select("topic", "bin", "value", "norm", "repeated")


QUERIES = {
    f.__name__: f
    for f in (
        series_trailing_baseline, series_raw_baseline, series_preceding_values, series_adjacent_deltas, series_gap_islands, series_gap_islands_all, series_normalisation_checks,
        series_numerator_failures, series_best_alert, series_requests, series_norm_failures, series_rollup_vs_daily, series_points_from_json, coverage_inventory,
    )
}

_WITH_RAW = f"WITH {_SQL_ALIGNED}, valued AS (SELECT *, CASE WHEN state <> 'excluded_latest_bin' THEN n END::DOUBLE AS raw FROM aligned),"
_DAYS = f"""WITH days AS (SELECT o_orderstatus AS topic, strftime(o_orderdate, '%Y%m%d000000') AS bin, count(*) AS n FROM orders GROUP BY 1, 2),
grid AS (SELECT topic, strftime(TIMESTAMP '{FIRST_DAY}' + to_days(CAST(d AS INTEGER)), '%Y%m%d%H%M%S') AS bin FROM (SELECT DISTINCT topic FROM days), range({DAYS}) AS r(d))"""
SQL = {
    "series_trailing_baseline": f"""{_WITH_RAW} {_sql_baseline('valued', 'per_10k', 10, 2.0)}
SELECT topic, bin, state, n AS article_count, total AS all_count, round(per_10k, 6) AS per_10k, round(baseline_mean, 6) AS baseline_mean, round(baseline_sd, 6) AS baseline_sd,
  round(threshold, 6) AS threshold, round(CASE WHEN baseline_mean <> 0 THEN per_10k / baseline_mean END, 6) AS fold, baseline_bins, candidate FROM alerts""",
    "series_raw_baseline": f"""{_WITH_RAW} {_sql_baseline('valued', 'raw', 10, 10.0)}
SELECT topic, bin, state, n AS article_count, round(baseline_mean, 6) AS baseline_mean, round(threshold, 6) AS threshold, round(raw / nullif(threshold, 0), 6) AS ratio, candidate FROM alerts""",
    "series_preceding_values": f"""WITH {_SQL_ALIGNED}
SELECT topic, bin, n AS article_count, CASE WHEN count(n) OVER w = 4 THEN string_agg(n::VARCHAR, ',' ORDER BY bin) OVER w END AS preceding FROM aligned
WINDOW w AS (PARTITION BY topic ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
    "series_adjacent_deltas": """WITH hours AS (SELECT DISTINCT event_type AS topic, date_trunc('hour', ts) AS h FROM events),
gaps AS (SELECT topic, date_diff('minute', lag(h) OVER (PARTITION BY topic ORDER BY h), h) AS minutes FROM hours)
SELECT topic, minutes, count(*) AS n_gaps FROM gaps WHERE minutes IS NOT NULL GROUP BY 1, 2""",
    "series_gap_islands": f"""{_DAYS},
seen AS (SELECT topic, bin, n IS NOT NULL AS s FROM grid LEFT JOIN days USING (topic, bin)),
steps AS (SELECT *, CASE WHEN s AND NOT coalesce(lag(s) OVER w, false) THEN 1 ELSE 0 END AS starts, max(bin) OVER (PARTITION BY topic) AS last FROM seen WINDOW w AS (PARTITION BY topic ORDER BY bin)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY topic ORDER BY bin)::BIGINT AS run FROM steps)
SELECT topic, run, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins, max(bin) = max(last) AS open_ended FROM runs WHERE s GROUP BY 1, 2""",
    "series_gap_islands_all": """WITH days AS (SELECT o_orderstatus AS topic, strftime(o_orderdate, '%Y%m%d000000') AS bin, count(*) AS n FROM orders GROUP BY 1, 2),
span AS (SELECT min(date_trunc('day', o_orderdate)) AS low, max(date_trunc('day', o_orderdate)) AS high FROM orders),
grid AS (SELECT topic, strftime(day, '%Y%m%d%H%M%S') AS bin FROM (SELECT DISTINCT topic FROM days), (SELECT unnest(generate_series(low::TIMESTAMP, high::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM span)),
seen AS (SELECT topic, bin, n IS NOT NULL AS s FROM grid LEFT JOIN days USING (topic, bin)),
steps AS (SELECT *, CASE WHEN s AND NOT coalesce(lag(s) OVER w, false) THEN 1 ELSE 0 END AS starts, max(bin) OVER (PARTITION BY topic) AS last FROM seen WINDOW w AS (PARTITION BY topic ORDER BY bin)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY topic ORDER BY bin)::BIGINT AS run FROM steps)
SELECT topic, run, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins, max(bin) = max(last) AS open_ended FROM runs WHERE s GROUP BY 1, 2""",
    "series_normalisation_checks": f"""WITH {_SQL_ALIGNED},
r AS (SELECT topic, n, total, CASE WHEN topic = 'click' THEN round(n * 100.0 / total, 3) ELSE round(n * 100.0 / total, 6) END AS percent FROM numerator JOIN denominator USING (bin) WHERE total > 0),
b AS (SELECT topic, count(*) AS n_bins, max(abs(percent - n * 100.0 / total)) AS error, bool_and(n <= total) AS within FROM r GROUP BY 1)
SELECT topic, n_bins, error <= 1e-5 AS percent_agrees, within, concat_ws('; ', CASE WHEN NOT error <= 1e-5 THEN 'percent differs' END, CASE WHEN NOT within THEN 'count above norm' END, CASE WHEN n_bins < 100 THEN 'few bins' END) AS failed,
  error <= 1e-5 AND within AND n_bins >= 100 AS verified FROM b""",
    "series_numerator_failures": f"""WITH {_SQL_ALIGNED},
c AS (SELECT bin, n FROM numerator WHERE topic = 'click'), v AS (SELECT bin, n AS total FROM numerator WHERE topic = 'view'),
j AS (SELECT c.bin, c.n, v.total, CASE WHEN v.total IS NULL THEN 'missing denominator bin' WHEN c.n <> v.total THEN 'norm differs' WHEN c.n > v.total THEN 'count outside denominator' END AS reason FROM c LEFT JOIN v USING (bin))
SELECT * FROM j WHERE reason IS NOT NULL""",
    "series_best_alert": f"""WITH raw_counts AS (SELECT event_type AS topic, date_trunc('hour', ts) AS h, count(*) AS c FROM events GROUP BY 1, 2),
numerator AS (SELECT topic, strftime(h, '%Y%m%d%H%M%S') AS bin, c * CASE WHEN topic <> 'view' AND hour(h) = 0 THEN 40 ELSE 1 END AS n FROM raw_counts),
{_SQL_ALIGNED[_SQL_ALIGNED.index('denominator AS'):]}, valued AS (SELECT *, CASE WHEN state <> 'excluded_latest_bin' THEN n END::DOUBLE AS raw FROM aligned),
w AS (SELECT *, count(per_10k) OVER f AS ks, avg(per_10k) OVER f AS ms, stddev_samp(per_10k) OVER f AS ss, count(raw) OVER f AS kr, avg(raw) OVER f AS mr, stddev_samp(raw) OVER f AS sr FROM valued
  WINDOW f AS (PARTITION BY topic ORDER BY bin ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
t AS (SELECT topic, bin, n, per_10k, raw, CASE WHEN ks = 7 THEN round(greatest(ms * 2, ms + ss * 3, ms + 2), 9) END AS ts, CASE WHEN kr = 7 THEN round(greatest(mr * 2, mr + sr * 3, mr + 10), 9) END AS tr FROM w),
c AS (SELECT topic, bin, n, round(per_10k / ts, 6) AS ratio, 'share' AS basis, 1 AS pick FROM t WHERE n >= 10 AND round(per_10k, 9) > ts UNION ALL SELECT topic, bin, n, round(raw / tr, 6), 'raw count only', 2 FROM t WHERE n >= 10 AND raw > tr)
SELECT topic, bin, n, ratio, basis FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY pick, ratio DESC, bin) = 1""",
    "series_requests": """WITH d AS (SELECT DISTINCT event_type AS topic, strftime(ts, '%d') AS d, strftime(ts, '%Y%m%d') AS day FROM events)
SELECT topic, CASE d WHEN '14' THEN 'not collected' WHEN '13' THEN '429' ELSE '200' END AS status, count(*) AS n_requests FROM d GROUP BY 1, 2""",
    "series_norm_failures": """WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1)
SELECT strftime(h, '%Y%m%d%H%M%S') AS bin, n AS low, n + 1 AS high FROM h WHERE hour(h) = 7 AND k = (SELECT count(DISTINCT event_type) FROM events)""",
    "series_rollup_vs_daily": """WITH h AS (SELECT event_type AS topic, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT topic, strftime(hour, '%Y%m%d') AS day, sum(n)::BIGINT AS n_rolled, count(*) AS n_hours FROM h GROUP BY 1, 2),
d AS (SELECT event_type AS topic, strftime(ts, '%Y%m%d') AS day, count(*) AS n_daily FROM events GROUP BY 1, 2)
SELECT topic, day, n_hours, n_rolled, n_daily, n_rolled = n_daily AS agrees FROM r FULL JOIN d USING (topic, day)""",
    "series_points_from_json": f"""WITH {_SQL_ALIGNED}
SELECT topic, bin, n AS value, total AS norm, false AS repeated FROM numerator JOIN denominator USING (bin) WHERE substr(bin, 7, 2) <> '13'""",
    "coverage_inventory": f"""{_DAYS},
s AS (SELECT coalesce(g.topic, d.topic) AS topic, g.bin AS e, d.bin AS o FROM grid g FULL JOIN days d ON g.topic = d.topic AND g.bin = d.bin)
SELECT topic, count(e) AS n_expected, count(o) AS n_observed, count(*) FILTER (o IS NULL) AS n_missing, count(*) FILTER (e IS NULL) AS n_outside, min(o) AS first_bin, max(o) AS last_bin FROM s GROUP BY 1""",
}
