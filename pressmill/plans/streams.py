"""Streaming queries run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.streaming import flows


def stream_closed_windows(spark, folder: str) -> DataFrame:
    """Events per type and closed 15-minute window."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, since a stream's plain path must be a folder and a table may be one file
    stream = flows.files_stream(spark, f"{folder}/events.parque[t]", schema).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = flows.run_to_end(flows.closed_windows(stream, "ts", "event_type"), "closed-windows")
    return rows.select("topic", F.date_format("start", "yyyyMMddHHmmss").alias("bin"), "n")


QUERIES = {"stream_closed_windows": stream_closed_windows}
SQL = {
    "stream_closed_windows": """WITH w AS (SELECT event_type AS topic, time_bucket(INTERVAL 15 MINUTE, ts) AS s, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS latest FROM events)
SELECT topic, strftime(s, '%Y%m%d%H%M%S') AS bin, n FROM w, m WHERE s + INTERVAL 15 MINUTE <= latest - INTERVAL 10 MINUTE""",
}
