"""Written times: vectors of every form, defined results, and zone changes against the zone database itself."""

import random
import zoneinfo
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pressmill.functions.zones import zone_intervals
from pressmill.operators.instants import iso_utc, normalise_instants

CASES = [
    ("2025-06-30T19:02:12+00:00", None, "2025-06-30T19:02:12Z"),
    ("2025-06-30T19:02:12+05:45", None, "2025-06-30T13:17:12Z"),
    ("2025-06-30T19:02-0330", None, "2025-06-30T22:32:00Z"),
    ("  2025-07-01 18:29:46 GMT+9", None, "2025-07-01T09:29:46Z"),
    ("20250630t071348z\n", None, "2025-06-30T07:13:48Z"),
    ("20250630T0713Z", None, "2025-06-30T07:13:00Z"),
    ("1751198315", None, "2025-06-29T11:58:35Z"),
    ("1751322440847", None, "2025-06-30T22:27:20Z"),
    ("Fri, 27 Jun 2025 23:46:26 +0300", None, "2025-06-27T20:46:26Z"),
    ("28 June 2025, 23:34 JST", None, "2025-06-28T14:34:00Z"),
    ("23 de noviembre de 2025, 19:55 h (EDT)", None, "2025-11-23T23:55:00Z"),
    ("15. Januar 2026, 06:43 Uhr PST", None, "2026-01-15T14:43:00Z"),
    ("17 août 2025 à 02h26 EDT", None, "2025-08-17T06:26:00Z"),
    ("2025年11月8日 07:54 PST", None, "2025-11-08T15:54:00Z"),
    ("Dec 28, 2025 12:10 AM EDT", None, "2025-12-28T04:10:00Z"),
    ("Dec 28, 2025 12:10 PM UTC", None, "2025-12-28T12:10:00Z"),
    ("26/11/2025 17:48 UTC+05:30", None, "2025-11-26T12:18:00Z"),
    ("05/05/2025 10:00 UTC+00:00", None, "2025-05-05T10:00:00Z"),
    ("2026-01-11T15:30:42,833+08:00", None, "2026-01-11T07:30:42Z"),
    ("2026-01-05T01:46:27[Australia/Sydney]", None, "2026-01-04T14:46:27Z"),
    ("2025-09-19T10:41:33 America/Chicago", None, "2025-09-19T15:41:33Z"),
    ("2025-06-30 21:00:07", "local clock, zone America/Sao_Paulo", "2025-07-01T00:00:07Z"),
    ("2025-06-30T21:00:07+02:00", "local clock, zone America/Sao_Paulo", "2025-06-30T19:00:07Z"),
    ("2025-06-30 21:00:07", "timezone unknown", "no_zone"),
    ("2025-11-02T01:24:29", "wall time at desk (America/New_York)", "ambiguous"),
    ("2026-03-29 02:29:02", "Europe/Madrid local time per imprint", "nonexistent"),
    ("2026-03-29T02:29:02 Nowhere/Land", None, "unknown_zone"),
    ("04/08/2025 02:08 UTC-07:00", None, "swappable"),
    ("1985-07-01 10:00 Europe/Berlin", None, "1985-07-01T08:00:00Z"),
    ("2050-07-01 10:00 Europe/Berlin", None, "2050-07-01T08:00:00Z"),
    ("2177-12-01 10:00 Europe/Berlin", None, "2177-12-01T09:00:00Z"),
    ("2499-03-29 02:30 Europe/Berlin", None, "nonexistent"),
    ("1066-10-14 09:00 Europe/London", None, "1066-10-14T09:01:15Z"),
    ("2025-07-01 10:00 Etc/UTC", None, "2025-07-01T10:00:00Z"),
    ("2025-07-01 10:00 Etc/GMT+5", None, "2025-07-01T15:00:00Z"),
    ("2025-07-01 10:00 Japan", None, "2025-07-01T01:00:00Z"),
    ("2025-07-01 10:00", "clock of America/Argentina/Buenos_Aires.", "2025-07-01T13:00:00Z"),
    ("2025-07-01 10:00 somewhere", None, "unknown_zone"),
    ("2025-06-31T25:10:00Z", None, "impossible"),
    ("2025-02-29T10:00:00Z", None, "impossible"),
    ("2024-02-29T10:00:00Z", None, "2024-02-29T10:00:00Z"),
    ("2025-06-30", None, "no_time"),
    ("2025", None, "no_time"),
    ("2025-12", None, "no_time"),
    ("yesterday", None, "unreadable"),
    ("updated 13 hours ago", None, "unreadable"),
    ("20250901084500", None, "no_zone"),
    ("", None, "missing"),
    ("   ", None, "missing"),
    (None, "Europe/Madrid", "missing"),
    ("x" * 100_000, None, "unreadable"),
]


@pytest.fixture(scope="module")
def resolved(spark):
    rows = spark.createDataFrame([(i, v, h) for i, (v, h, _) in enumerate(CASES)], "i int, v string, h string")
    out = normalise_instants(rows, "v", "h").select("i", F.coalesce(iso_utc(F.col("instant.epoch_second")), F.col("instant.status")).alias("r"))
    return {r.i: r.r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_vector(resolved, i):
    assert resolved[i] == CASES[i][2]


def test_fourteen_digits_where_they_are_utc(spark):
    df = spark.createDataFrame([("20250901084500",)], "v string")
    assert normalise_instants(df, "v", bare_digits_utc=True).select(iso_utc(F.col("instant.epoch_second"))).first()[0] == "2025-09-01T08:45:00Z"


def test_clashing_names_repeats_and_empty(spark):
    rows = spark.createDataFrame([("2025-06-30T00:00:00Z", "a", 1)] * 3, "zone string, local string, stated int").withColumnRenamed("zone", "zone_year")
    out = normalise_instants(rows, "zone_year")
    assert out.columns == ["zone_year", "local", "stated", "instant"]
    assert out.count() == 3
    assert normalise_instants(rows.limit(0), "zone_year").count() == 0


def test_intervals_are_those_of_the_database():
    """Every zone's offset at random instants of three centuries."""
    r = random.Random(4)
    for name in sorted(zoneinfo.available_timezones()):
        zone, spans = zoneinfo.ZoneInfo(name), zone_intervals(name)
        for _ in range(40):
            moment = datetime(1805, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=r.randrange(312 * 365 * 86400))
            second = int(moment.timestamp())
            assert next(o for a, b, o in spans if a <= second < b) == moment.astimezone(zone).utcoffset().total_seconds(), (name, moment)


@pytest.mark.parametrize("name", ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca"])
def test_local_times_against_the_database(spark, name):
    """Each half hour around the year's changes: as many instants show it on the clock as intervals hold it."""
    zone = zoneinfo.ZoneInfo(name)
    start = datetime(2025, 1, 1)
    moments = [start + timedelta(minutes=30 * k) for k in range(2 * 24 * 365)]
    instants: dict[datetime, list[datetime]] = {}
    for k in range(-200, 2 * 24 * 370):
        utc = datetime(2024, 12, 30, tzinfo=timezone.utc) + timedelta(minutes=30 * k)
        instants.setdefault(utc.astimezone(zone).replace(tzinfo=None), []).append(utc)
    changes = [m for m in moments if len(instants.get(m, [])) != 1]
    chosen = sorted(set(changes) | {m + d for m in changes for d in (timedelta(minutes=-30), timedelta(minutes=30))} | set(moments[::97]))
    df = spark.createDataFrame([(m.strftime("%Y-%m-%dT%H:%M:%S"),) for m in chosen], "v string")
    got = {r.v: (r.s, r.u) for r in normalise_instants(df, "v", F.lit(name)).select("v", F.col("instant.status").alias("s"), iso_utc(F.col("instant.epoch_second")).alias("u")).collect()}
    for m in chosen:
        want = instants.get(m, [])
        status, utc = got[m.strftime("%Y-%m-%dT%H:%M:%S")]
        assert status == {0: "nonexistent", 1: "resolved"}.get(len(want), "ambiguous")
        if len(want) == 1:
            assert utc == want[0].strftime("%Y-%m-%dT%H:%M:%SZ")
