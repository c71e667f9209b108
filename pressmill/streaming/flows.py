"""Structured Streaming twins: closed windows, first deliveries, corrected counters, running baselines.

Every flow runs to the end of what is there (``availableNow``) and writes to a folder
that all executors share; a restarted flow goes on from its checkpoint.
"""

from __future__ import annotations

import statistics
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressmill.operators import counters
from pressmill.shared import discard, materialize, shared_folder, ship


def files_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, a bounded number to a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode flow over all that is there and return what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def closed_windows(stream: DataFrame, moment: str, key: str, width: str = "15 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts per window and key, emitted only once the watermark has passed the window's end: the latest bin is provisional and withheld."""
    counted = stream.withWatermark(moment, lateness).groupBy(F.window(moment, width), F.col(key).alias("topic")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "topic", "n")


def keep_first(stream: DataFrame, moment: str, keys: list[str], lateness: str) -> DataFrame:
    """The first delivery of each key while the watermark remembers it."""
    return stream.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(keys)


def running_baseline(bins: DataFrame, least_count: int = 10, floor: float = 2.0) -> DataFrame:
    """Alerts on a stream of closed bins (topic, number, n): the seven numbers before a bin must all have come.

    ``number`` counts grid bins, so a gap is seen and starts the baseline anew; a bin that
    comes after a later one has lost its turn and gives no row.
    """
    ship(bins.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ring = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        rows = []
        frames = [b for b in batches]
        for number, n in sorted(zip(*(pd.concat(frames)[c].tolist() for c in ("number", "n")), strict=True)):
            if last is not None and number <= last:
                continue
            if last is not None and number != last + 1:
                ring = []
            mean = statistics.fmean(ring) if len(ring) == 7 else None
            limit = max(2 * mean, mean + 3 * statistics.stdev(ring), mean + floor) if mean is not None else None
            rows.append((key[0], number, n, mean, limit, bool(limit is not None and n >= least_count and n > limit)))
            ring, last = [*ring, float(n)][-7:], number
        state.update((last, ring))
        yield pd.DataFrame(rows, columns=["topic", "number", "n", "mean", "threshold", "candidate"])

    out = "topic string, number bigint, n bigint, mean double, threshold double, candidate boolean"
    return bins.groupBy("topic").applyInPandasWithState(step, out, "last bigint, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def corrected_counts(stream: DataFrame, to_first, path: str | None = None) -> DataFrame:
    """Counters of deliveries over a stream: (day, key, n, n_late) after all that has arrived.

    ``to_first`` turns a trigger's deliveries into first deliveries (``counters.first_deliveries``).
    What a trigger changes is appended to two logs under ``path``: first deliveries, by source, and
    the counter rows of the sources' next versions. A trigger reads the first deliveries of the sources
    it touches and rewrites nothing; its folders bear its number, so a trigger that is run again
    replaces what it wrote before. A flow started again with the same ``path`` goes on from there;
    without one it has a folder of its own. A stream without deliveries gives an empty result.
    """
    spark = stream.sparkSession
    base = path or f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}"

    def log(kind: str, schema: str, before: int | None = None) -> DataFrame:
        """What the triggers before the one given have appended."""
        jvm = spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}/trigger=*")
        found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        names = [str(f.getPath()) for f in found]
        wanted = sorted(n for n in names if before is None or int(n.rsplit("=", 1)[1]) < before)
        if not wanted:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{base}/{kind}").parquet(*wanted).drop("trigger")

    def fold(batch: DataFrame, number: int) -> None:
        first = materialize(to_first(batch), "trigger")
        schema = first.schema.simpleString()[7:-1].replace(":", " ")
        touched = [r.source for r in first.select("source").distinct().collect()]  # one row per source
        known = log("first", schema, number).where(F.col("source").isin(touched))
        # the log holds each improvement of an identity: the least is what stands
        place = F.struct("intake", "tie", "day", "key", "late", "source")
        stands = known.join(first.select("identity"), "identity", "left_semi").groupBy("identity").agg(F.min(place).alias("r")).select("identity", "r.*")
        pairs = materialize(counters.pairs(stands, first, "right").where("changed"), "trigger-pairs")
        pairs.select("identity", "new.*").write.mode("overwrite").partitionBy("source").parquet(f"{base}/first/trigger={number}")
        counters.corrections(pairs, log("rows", counters.ROW_SCHEMA.format(key=dict(first.dtypes)["key"]), number)).write.mode("overwrite").parquet(f"{base}/rows/trigger={number}")
        discard(pairs)
        discard(first)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    key = dict(to_first(spark.createDataFrame([], stream.schema)).dtypes)["key"]
    return counters.totals(log("rows", counters.ROW_SCHEMA.format(key=key)))
