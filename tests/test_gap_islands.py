"""Islands on every day that the table has."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_last_order_day_is_in_an_island(spark, folder):
    last = spark.read.parquet(f"{folder}/orders.parquet").agg(F.date_format(F.max("o_orderdate"), "yyyyMMdd000000")).first()[0]
    rows = entry.queries()["series_gap_islands_all"](spark, folder).collect()
    assert max(r.last_bin for r in rows) == last and any(r.open_ended for r in rows if r.last_bin == last)
    days = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderstatus", F.to_date("o_orderdate")).distinct().count()
    assert sum(r.n_bins for r in rows) == days
