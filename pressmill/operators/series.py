"""Count series on explicit time grids: states, baselines, checks and alerts.

A missing bin stays missing: it is never zero, it breaks every baseline that needs it,
and a missing denominator withholds the comparison. Grids are half open and given by
their first bin, step and number of bins, so their size does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABEL = "yyyyMMddHHmmss"
BASELINE = 7


def label_of(moment: Column) -> Column:
    """Compact bin label; its text order is its time order."""
    return F.date_format(moment, LABEL)


def grid(keys: DataFrame, first: str, step: str, bins: int) -> DataFrame:
    """Every key with every expected bin: keys, moment, bin."""
    start = F.to_timestamp_ntz(F.lit(first))
    moments = F.sequence(start, start + F.expr(f"INTERVAL '1' {step}") * (bins - 1), F.expr(f"INTERVAL '1' {step}"))
    return keys.withColumn("moment", F.explode(moments)).withColumn("bin", label_of(F.col("moment")))


def counts(df: DataFrame, key: str, moment: str, step: str) -> DataFrame:
    """Rows per key and bin: key, bin, n."""
    return df.groupBy(F.col(key).alias("topic"), label_of(F.date_trunc(step, F.col(moment)).cast("timestamp_ntz")).alias("bin")).agg(F.count("*").alias("n"))


def aligned(expected: DataFrame, numerator: DataFrame, denominator: DataFrame, verified: Column | None = None) -> DataFrame:
    """The grid with counts, totals and each row's state; the comparison value only where observed.

    States by precedence: missing, unverified_denominator, excluded_latest_bin (the last
    bin that either series has is provisional), observed.
    """
    rows = expected.join(numerator, ["topic", "bin"], "left").join(denominator, ["bin"], "left")
    any_value = F.col("n").isNotNull() | F.col("total").isNotNull()
    rows = rows.withColumn("latest", F.max(F.when(any_value, F.col("bin"))).over(Window.partitionBy("topic")))
    state = (
        F.when(F.col("n").isNull() | F.col("total").isNull(), "missing")
        .when(~(verified if verified is not None else F.lit(True)) | (F.col("total") <= 0), "unverified_denominator")
        .when(F.col("bin") == F.col("latest"), "excluded_latest_bin")
        .otherwise("observed")
    )
    rows = rows.withColumn("state", state)
    return rows.withColumn("per_10k", F.when(F.col("state") == "observed", F.try_divide(F.col("n") * F.lit(10000.0), F.col("total"))))


def trailing_baseline(rows: DataFrame, value: str, count: str, floor: float = 2.0, least_count: int = 10) -> DataFrame:
    """Mean, sample deviation and threshold of exactly the seven preceding grid bins, and whether the row exceeds it.

    The current row never enters its baseline; one missing bin among the seven, or a
    missing current value, leaves everything null.
    """
    before = Window.partitionBy("topic").orderBy("bin").rowsBetween(-BASELINE, -1)
    whole = (F.count(value).over(before) == BASELINE) & F.col(value).isNotNull()
    rows = rows.withColumn("baseline_mean", F.when(whole, F.avg(value).over(before)))
    rows = rows.withColumn("baseline_sd", F.when(whole, F.stddev_samp(value).over(before)))
    rows = rows.withColumn("baseline_bins", F.when(whole, F.concat_ws(",", F.collect_list("bin").over(before))))
    mean, sd = F.col("baseline_mean"), F.col("baseline_sd")
    rows = rows.withColumn("threshold", F.round(F.greatest(mean * 2, mean + sd * 3, mean + F.lit(floor)), 9))
    rows = rows.withColumn("fold", F.try_divide(F.col(value), F.when(mean != 0, mean)))
    return rows.withColumn("candidate", (F.col(count) >= least_count) & (F.round(value, 9) > F.col("threshold")))


def preceding_values(rows: DataFrame, value: str, steps: int) -> DataFrame:
    """The ``steps`` values before each grid row as text, null unless all are there."""
    before = Window.partitionBy("topic").orderBy("bin").rowsBetween(-steps, -1)
    whole = F.count(value).over(before) == steps
    return rows.withColumn("preceding", F.when(whole, F.concat_ws(",", F.collect_list(F.col(value).cast("string")).over(before))))


def adjacent_deltas(rows: DataFrame, moment: str) -> DataFrame:
    """Minutes between each observed bin and the one before it, with how often each gap occurs."""
    before = F.lag(moment).over(Window.partitionBy("topic").orderBy(moment))
    minutes = F.round((F.unix_micros(F.col(moment).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 60_000_000).cast("bigint")
    gaps = rows.withColumn("minutes", minutes).where("minutes is not null")
    return gaps.groupBy("topic", "minutes").agg(F.count("*").alias("n_gaps"))


def islands(rows: DataFrame, seen: Column) -> DataFrame:
    """Runs of observed rows: number of each run, first and last bin, length, and whether it ends the series."""
    order = Window.partitionBy("topic").orderBy("bin")
    marked = rows.withColumn("seen", seen)
    marked = marked.withColumn("run", F.sum(F.when(F.col("seen") & ~F.coalesce(F.lag("seen").over(order), F.lit(False)), 1).otherwise(0)).over(order))
    last = marked.withColumn("end", F.max("bin").over(Window.partitionBy("topic")))
    runs = last.where("seen").groupBy("topic", "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("n_bins"), F.max("end").alias("end"))
    return runs.withColumn("open_ended", F.col("last_bin") == F.col("end")).drop("end")


def numerator_failures(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """Numerator bins whose denominator is missing, differs in its norm or is smaller."""
    both = numerator.join(denominator, "bin", "left")
    reason = (
        F.when(F.col("total").isNull(), "missing denominator bin")
        .when(F.col("norm") != F.col("total_norm"), "norm differs")
        .when((F.col("n") < 0) | (F.col("n") > F.col("total")), "count outside denominator")
    )
    return both.withColumn("reason", reason).where("reason is not null")


def best_per_topic(rows: DataFrame, ratio: str) -> DataFrame:
    """Each topic's row with the greatest ratio, the earliest of equals."""
    order = Window.partitionBy("topic").orderBy(F.desc(ratio), "bin")
    return rows.where(F.col(ratio).isNotNull()).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def chosen_alert(shares: DataFrame, raw: DataFrame, verified: bool) -> DataFrame:
    """Each topic's alert of the greatest ratio to its threshold, the earliest of equals: by share, or, only
    where normalisation isn't verified, by raw counts for topics without one. Both sides have topic, bin, n, ratio, candidate.
    """
    best = best_per_topic(shares.where("candidate"), "ratio").select("topic", "bin", "n", "ratio", F.lit("share").alias("basis"))
    if verified:
        return best
    rest = raw.where("candidate").join(best.select("topic"), "topic", "left_anti")
    return best.unionAll(best_per_topic(rest, "ratio").select("topic", "bin", "n", "ratio", F.lit("raw count only").alias("basis")))


def norm_failures(points: DataFrame) -> DataFrame:
    """Bins common to all topics whose norm isn't the same in each: bin, low, high; none where all agree."""
    topics = points.select("topic").distinct().agg(F.count("*").alias("n_topics"))
    bins = points.groupBy("bin").agg(F.countDistinct("topic").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count_if(F.col("norm").isNull()).alias("unknown"))
    common = bins.join(F.broadcast(topics), F.col("n") == F.col("n_topics"))  # one row
    return common.where((F.col("low") != F.col("high")) | (F.col("unknown") > 0)).select("bin", "low", "high")


def collected(expected: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Every expected request with its status, ``not collected`` where no response was saved."""
    known = responses.groupBy(key).agg(F.max("status").alias("_status"))
    return expected.join(known, key, "left").withColumn("status", F.coalesce(F.col("_status").cast("string"), F.lit("not collected"))).drop("_status")


def coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per topic: bins expected, observed, missing and outside the grid, first and last observed."""
    sides = expected.select("topic", "bin", F.lit(True).alias("e")).join(observed.select("topic", "bin", F.lit(True).alias("o")).distinct(), ["topic", "bin"], "full")
    return sides.groupBy("topic").agg(
        F.count("e").alias("n_expected"), F.count("o").alias("n_observed"), F.count_if(F.col("e") & F.col("o").isNull()).alias("n_missing"),
        F.count_if(F.col("o") & F.col("e").isNull()).alias("n_outside"), F.min(F.when(F.col("o"), F.col("bin"))).alias("first_bin"), F.max(F.when(F.col("o"), F.col("bin"))).alias("last_bin"),
    )


SNAPSHOT = "status int, data struct<timeline: array<struct<series string, data: array<struct<date string, value bigint, norm bigint>>>>>"
SNAPSHOT_TYPE = "struct<status:int,data:struct<timeline:array<struct<series:string,data:array<struct<date:string,value:bigint,norm:bigint>>>>>>"


def points(df: DataFrame, body: str) -> DataFrame:
    """Points of request snapshots: only successful ones with exactly one series; repeated bins are flagged, not summed."""
    parsed = df.withColumn("_s", F.from_json(body, SNAPSHOT_TYPE))
    ok = (F.col("_s.status") == 200) & (F.size("_s.data.timeline") == 1)
    rows = parsed.where(ok).withColumn("_p", F.explode(F.get("_s.data.timeline", F.lit(0))["data"]))
    twice = Window.partitionBy(*[c for c in df.columns if c != body], "bin")
    rows = rows.select(*[c for c in df.columns if c != body], F.col("_p.date").alias("bin"), F.col("_p.value").alias("value"), F.col("_p.norm").alias("norm"))
    return rows.withColumn("repeated", F.count("*").over(twice) > 1)
