"""Archive batches: as-of de-duplication, exposure shares, collisions, links and overlaps.

A batch label is when a row became visible. Nothing of a later batch may change what an
earlier cutoff shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_label(moment: Column, minutes: int = 15) -> Column:
    """Label of the batch that holds a moment given as yyyyMMddHHmmss text: its minutes rounded down."""
    minute = F.substring(moment, 11, 2).cast("int")
    return F.concat(F.substring(moment, 1, 10), F.lpad((F.floor(minute / minutes) * minutes).cast("string"), 2, "0"), F.lit("00"))


def valid_stamp(label: Column, minutes: int = 15) -> Column:
    """Fourteen digits that are a real date and a batch's start."""
    real = F.try_to_timestamp(label, F.lit("yyyyMMddHHmmss")).isNotNull()
    return F.coalesce(label.rlike(r"^\d{14}$") & real & (F.substring(label, 11, 2).cast("int") % minutes == 0) & (F.substring(label, 13, 2) == "00"), F.lit(False))


def deduplicate_as_of(rows: DataFrame, keys: list[str], cutoff: str | None = None) -> DataFrame:
    """One row per document: its earliest batch up to the cutoff and, in it, the least record id.

    An unknown language is a language of its own: where the first batch has more than one, the document's
    is null and its status ``ambiguous_first_batch``. Two aggregates, both combined before their shuffle;
    no window over a document's rows.
    """
    seen = rows.where("batch is not null")
    if cutoff is not None:
        seen = seen.where(F.col("batch") <= cutoff)
    by_batch = seen.groupBy(*keys, "batch").agg(F.min("record_id").alias("record_id"), F.min("language").alias("low"), F.max("language").alias("high"), F.bool_or(F.col("language").isNull()).alias("unknown"))
    first = by_batch.groupBy(*keys).agg(F.min(F.struct("batch", "record_id", "low", "high", "unknown")).alias("f"))
    several = F.coalesce((F.col("f.low") != F.col("f.high")) | (F.col("f.low").isNotNull() & F.col("f.unknown")), F.lit(False))
    return first.select(*keys, "f.batch", "f.record_id", F.when(~several, F.col("f.low")).alias("language"), F.when(several, "ambiguous_first_batch").otherwise("single").alias("language_status"))


def observed_share(documents: DataFrame, expected: DataFrame, topic: str, as_of: str | None = None) -> DataFrame:
    """Per expected language and bin: documents on the topic among all first seen then, with the reason where there is no share.

    ``documents`` has language, bin, topic; ``expected`` language and bin. Where a document's topic is
    unknown (null), the share is not known either. A bin expected after ``as_of`` is an error: nobody can have seen it.
    """
    if as_of is not None and not expected.where(F.col("bin") > as_of).isEmpty():
        raise ValueError(f"bins after {as_of} can't have been observed")
    by_bin = documents.groupBy("bin").agg(F.count("*").alias("n_bin"))
    usable = documents.where("language is not null").groupBy("language", "bin").agg(F.count("*").alias("n_all"), F.count_if(F.col("topic") == topic).alias("n_on_topic"), F.count_if(F.col("topic").isNull()).alias("n_unknown"))
    rows = expected.join(by_bin, "bin", "left").join(usable, ["language", "bin"], "left")
    status = F.when(F.col("n_bin").isNull(), "missing_bin").when(F.col("n_all").isNull(), "no_usable_language_exposure").when(F.col("n_unknown") > 0, "topic_membership_unverified").otherwise("observed")
    rows = rows.withColumn("n_topic", F.when(F.col("n_unknown") == 0, F.col("n_on_topic")))
    return rows.select("language", "bin", status.alias("status"), "n_topic", "n_all", F.try_divide(F.col("n_topic").cast("double"), F.col("n_all")).alias("share"))


def collisions(rows: DataFrame, key: str, document: str) -> DataFrame:
    """Keys that name more than one document."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(document).isNotNull()).groupBy(key, document).agg(F.count("*").alias("n"))
    return pairs.groupBy(key).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_rows"), F.min(document).alias("first_document"), F.max(document).alias("last_document")).where("n_documents > 1")


def asof_links(probes: DataFrame, history: DataFrame, key: str, bin_column: str) -> DataFrame:
    """Of each probe, history rows of its key: any, as of its bin (all matches counted), and in its bin.

    Both sides are counted per key and bin first, and a running sum over a key's bins
    gives the as-of count, so no probe meets each of its history rows. A key has at most
    as many rows as there are bins.
    """
    a = probes.groupBy(key, bin_column).agg(F.lit(0).cast("bigint").alias("n"))
    b = history.groupBy(key, bin_column).agg(F.count("*").alias("n"))
    both = a.unionAll(b).groupBy(key, bin_column).agg(F.sum("n").alias("n_same"))
    running = Window.partitionBy(key).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, 0)
    sums = both.select(key, bin_column, "n_same", F.sum("n_same").over(running).alias("n_as_of"), F.sum("n_same").over(Window.partitionBy(key)).alias("n_any"))
    return probes.join(sums, [key, bin_column], "left")


def asof_rows(probes: DataFrame, history: DataFrame, key: str, bin_column: str, value: str) -> DataFrame:
    """Of each (key, bin) of the probes, every history row of its key as of its bin: an array of (bin, value), in order.

    The result holds each history row once for every later bin of its key that is probed, which is
    what is asked for; probes of one bin share it. ``asof_links`` has the counts alone.
    """
    bins = probes.select(F.col(key).alias("k"), F.col(bin_column).alias("at")).distinct()
    seen = history.select(F.col(key).alias("k"), F.struct(F.col(bin_column).alias("bin"), F.col(value).alias("value")).alias("r"))
    rows = bins.join(seen, "k", "left").groupBy("k", "at").agg(F.array_sort(F.collect_list(F.when(F.col("r.bin") <= F.col("at"), F.col("r")))).alias("as_of_rows"))
    return rows.select(F.col("k").alias(key), F.col("at").alias(bin_column), "as_of_rows")


def must_match(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of a lookup table; a row whose key the table lacks, or a key that it has twice, is an error."""
    known = lookup.groupBy(key).agg(F.count("*").alias("_times"), F.first(F.struct(*[c for c in lookup.columns if c != key])).alias("_found"))
    joined = rows.join(known, key, "left")
    checked = F.when(F.col("_times") == 1, F.col("_found")).otherwise(F.raise_error(F.concat(F.lit("no single entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn("_found", checked).select(*rows.columns, "_found.*")


def last_row(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order)).select(key, order, "r.*")


def first_by_priority(streams: list[DataFrame], key: str) -> DataFrame:
    """Streams in order of priority, one row per key from the first stream that has it, its least record id."""
    out = None
    for rank, rows in enumerate(streams, 1):
        ranked = rows.withColumn("priority", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "priority", "record_id")]
    return out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("priority", "record_id", *rest)).alias("r")).select(key, "r.*")


def checksum_agreement(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Whether a file's size and digest agree with its manifest entry; null where there is none."""
    joined = files.join(manifest, key, "left")
    return joined.withColumn("agrees", (F.col("size") == F.col("listed_size")) & (F.col("digest") == F.col("listed_digest")))


def group_stats(rows: DataFrame, groups: list[str]) -> DataFrame:
    """n, successes, failures and failure fraction over all rows and by each grouping column.

    The fraction is null for empty groups, and for groups that only successes can be in
    (their failures are unknown, not zero), which a column name ending in _inferred says.
    """
    parts = [F.lit("all").alias("scope"), F.lit("all").alias("value")]
    long = rows.select(F.explode(F.array(F.struct(*parts), *[F.struct(F.lit(g).alias("scope"), F.col(g).alias("value")) for g in groups])).alias("g"), "success")
    sums = long.groupBy("g.scope", "g.value").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"))
    unknown = F.col("scope").endswith("_inferred")
    failures = F.when(~unknown, F.col("n") - F.col("n_success"))
    return sums.select("scope", "value", "n", "n_success", failures.alias("n_failed"), F.try_divide(failures.cast("double"), F.col("n")).alias("failed_fraction"))


def hash_sample(rows: DataFrame, stratum: str, url: str, seed: str, quota: int) -> DataFrame:
    """The quota of each stratum in the order of a seeded digest of the url; equal urls keep record order."""
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("|", F.lit(seed), url), 256))
    order = Window.partitionBy(stratum).orderBy("digest", "record_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)


def weighted_vote(rows: DataFrame, key: str, label: str, weight: str) -> DataFrame:
    """Each key's label of greatest weight (the least of equals) and its share of the weight."""
    votes = rows.groupBy(key, label).agg(F.sum(weight).alias("w"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(label).alias("l"))).alias("best"), F.sum("w").alias("total")).select(
        key, F.col("best.l").alias("label"), F.try_divide(-F.col("best.m").cast("double"), "total").alias("agreement")
    )
