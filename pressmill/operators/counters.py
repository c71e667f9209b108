"""Counts per event period that late, repeated and reordered deliveries correct, with a cut-off.

Deliveries carry an identity, the time they were taken in and the time they speak of; only
an identity's first delivery counts. A ``State`` is what a set of deliveries leaves behind:

* ``first``: each identity's first delivery, the period and key it counts for, whether it came
  too late, and the source it belongs to, which is a shard of identities;
* ``counters``: conflict-free counters, rows (day, key, source, version, n, n_late). A source
  alone writes its rows. It numbers them by a sequence of its own, which it raises by one whenever
  deliveries change its counts, and a row holds its whole count as of that version.

``advance`` lets a state take in further deliveries. Where an earlier delivery of a known
identity arrives, its source takes the identity out of the period it stood in and puts it into
the new one, both as rows of its next version. ``merge_states`` takes the first deliveries of
one state into another, so states of separate batches, in any order and however often, come to
the counts of all their deliveries together. Counter rows that travel (retried, reordered,
delayed) are merged by ``merge_snapshots``, the highest version of each source, and ``totals``
sums the sources.

Defined results: rows without identity or intake time are no deliveries; without event
time a delivery is in no period and never late; ties on the intake time go to the least
``tie`` value, then to the least day and key; repeated rows count once; null keys form a key
of their own; an empty table gives empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.operators.instants import normalise_instants
from pressmill.shared import materialize
from pressmill.tables import table

DAY = 86400
SOURCES = 16
_REGISTER = ("intake", "tie", "day", "key", "late", "source")
_COUNTER = ("day", "key", "source", "version", "n", "n_late")
ROW_SCHEMA = "day bigint, key {key}, source int, version bigint, n bigint, n_late bigint"


@dataclass(frozen=True)
class State:
    """First deliveries by identity, and the counter rows that the sources have written so far."""

    first: DataFrame
    counters: DataFrame


def first_deliveries(df: DataFrame, identity: Column, intake_micros: Column, tie: Column, event_second: Column, key: Column, lateness_hours: int, sources: int = SOURCES) -> DataFrame:
    """One row per identity: tie value of its first delivery, key, intake, period (UTC day), late, source.

    The minimum is combined before the shuffle, so an identity that is delivered
    again and again sends one row per input partition.
    """
    wanted = F.struct(intake_micros.alias("intake"), tie.alias("tie"), F.floor(event_second / DAY).alias("day"), key.alias("key"))
    rows = df.select(identity.alias("identity"), wanted.alias("d")).where("identity is not null and d.intake is not null")
    first = rows.groupBy("identity").agg(F.min("d").alias("d")).select("identity", "d.*")
    limit = ((F.col("day") + 1) * DAY + lateness_hours * 3600) * 1_000_000
    source = F.pmod(F.xxhash64("identity"), F.lit(sources)).cast("int")
    return first.select("identity", "intake", "tie", "day", "key", F.coalesce(F.col("intake") > limit, F.lit(False)).alias("late"), source.alias("source"))


def begin(first: DataFrame) -> State:
    """The state of one batch of first deliveries: every source's version 1."""
    first = materialize(first.select("identity", *_REGISTER), "first-deliveries")
    n, late = F.count_if(~F.col("late")), F.count_if("late")
    counters = first.where("day is not null").groupBy("day", "key", "source").agg(F.lit(1).cast("bigint").alias("version"), n.alias("n"), late.alias("n_late"))
    return State(first, counters.select(*_COUNTER))


def pairs(known: DataFrame, incoming: DataFrame, how: str) -> DataFrame:
    """(identity, old, new, changed): what is known of an identity and what comes in, and whether the latter is earlier."""
    old = known.select("identity", F.struct(*_REGISTER).alias("old"))
    new = incoming.select("identity", F.struct(*_REGISTER).alias("new"))
    place = lambda side: F.struct(*[f"{side}.{c}" for c in ("intake", "tie", "day", "key")])
    earlier = F.col("old").isNull() | (F.col("new").isNotNull() & (place("new") < place("old")))
    return old.join(new, "identity", how).withColumn("changed", earlier)


def corrections(both: DataFrame, counters: DataFrame) -> DataFrame:
    """The counter rows of the next version of each source: whole counts of the periods that changed pairs touch."""
    moved = both.where("changed").select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("r")))).alias("m"))
    moved = moved.select("m.sign", "m.r.*").where("day is not null")
    by = F.sum(F.when(F.col("late"), 0).otherwise(F.col("sign"))), F.sum(F.when(F.col("late"), F.col("sign")).otherwise(0))
    change = moved.groupBy("day", "key", "source").agg(by[0].alias("dn"), by[1].alias("dl")).where("dn <> 0 or dl <> 0")
    last = merge_snapshots(counters).select(F.col("day").alias("d"), F.col("key").alias("k"), F.col("source").alias("s"), F.col("n").alias("was"), F.col("n_late").alias("was_late"))
    same = (F.col("day") == F.col("d")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("source") == F.col("s"))
    sequence = counters.groupBy(F.col("source").alias("s2")).agg(F.max("version").alias("at"))  # a row per source
    rows = change.join(last, same, "left").join(F.broadcast(sequence), F.col("source") == F.col("s2"), "left")
    n, late = F.coalesce("was", F.lit(0)) + F.col("dn"), F.coalesce("was_late", F.lit(0)) + F.col("dl")
    return rows.select("day", "key", "source", (F.coalesce("at", F.lit(0)) + 1).cast("bigint").alias("version"), n.alias("n"), late.alias("n_late"))


def advance(state: State, incoming: DataFrame) -> State:
    """The state after further first deliveries: earlier ones replace what is known, and the counts follow."""
    both = materialize(pairs(state.first, incoming, "full"), "delivery-pairs")
    first = both.select("identity", F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")).alias("r")).select("identity", "r.*")
    return State(first, state.counters.unionAll(corrections(both, state.counters)))


def merge_states(*states: State) -> State:
    """One state with the first deliveries of all; the order of the states and repeated states change no count."""
    return reduce(lambda a, b: advance(a, b.first), states)


def merge_snapshots(*counters: DataFrame) -> DataFrame:
    """The highest version of each (day, key, source) over all counter rows that the sources have sent."""
    rows = reduce(DataFrame.unionAll, [c.select(*_COUNTER) for c in counters])
    last = rows.groupBy("day", "key", "source").agg(F.max(F.struct("version", "n", "n_late")).alias("v"))
    return last.select("day", "key", "source", "v.version", "v.n", "v.n_late")


def totals(counters: DataFrame) -> DataFrame:
    """Count per day and key, summed over the sources' highest versions; periods that are empty again have no row."""
    return merge_snapshots(counters).groupBy("day", "key").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late")).where("n > 0 or n_late > 0")


def late_deliveries(state: State) -> DataFrame:
    """First deliveries that came too late, listed for every period in which the sources count late ones."""
    held = merge_snapshots(state.counters).where("n_late > 0").select(F.col("day").alias("d"), F.col("key").alias("k"), F.col("source").alias("s"))
    same = (F.col("day") == F.col("d")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("source") == F.col("s"))
    return state.first.where("late").join(held, same, "left_semi")


def compact_utc_second(value: Column) -> Column:
    """Second of a ``YYYYMMDDThhmmssZ`` label, null for anything else."""
    ok = value.rlike(r"^\d{8}T([01]\d|2[0-3])[0-5]\d[0-5]\dZ$")
    days = F.when(ok, F.unix_date(F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd")))
    part = lambda at: F.substring(value, at, 2).cast("int")
    return F.when(ok, days.cast("bigint") * DAY + part(10) * 3600 + part(12) * 60 + part(14))


def _timeline(spark, folder: str) -> DataFrame:
    """Deliveries of timeline events; a missing seen date is replaced by the claim's instant."""
    rows = table(spark, folder, "timeline_data").select(
        "record_id", "id", "publisher", "precision", compact_utc_second(F.col("gdelt_seendate")).alias("seen"),
        F.unix_micros(F.try_to_timestamp("retrieved_at_utc")).alias("intake"), "publisher_publication_utc_claim",
    )
    rows = normalise_instants(rows, F.when(F.col("seen").isNull(), F.col("publisher_publication_utc_claim")), "precision")
    return materialize(rows.select("record_id", "id", "publisher", "intake", F.coalesce("seen", "instant.epoch_second").alias("event")), "deliveries")


def _first(rows: DataFrame, event: str, lateness_hours: int) -> DataFrame:
    return first_deliveries(rows, F.col("id"), F.col("intake"), F.col("record_id"), F.col(event), F.col("publisher"), lateness_hours)


def timeline_state(spark, folder: str, lateness_hours: int = 72, feeds: int = 2) -> State:
    """Timeline deliveries taken in by separate feeds, each with every ``feeds``-th record, and their states merged.

    What one feed counts under a later delivery, the next one's earlier delivery corrects.
    """
    rows = _timeline(spark, folder)
    feed = F.pmod(F.col("record_id"), F.lit(feeds))
    state = begin(_first(rows.where(feed == 0), "event", lateness_hours))
    for k in range(1, feeds):
        state = advance(state, _first(rows.where(feed == k), "event", lateness_hours))
    return state


def p4_seen_counts(spark, folder: str) -> DataFrame:
    """The same counters by seen date alone, without claims to fall back on."""
    rows = table(spark, folder, "timeline_data").select("record_id", "id", "publisher", compact_utc_second(F.col("gdelt_seendate")).alias("seen"), F.unix_micros(F.try_to_timestamp("retrieved_at_utc")).alias("intake"))
    return _dated(totals(begin(_first(rows, "seen", 72)).counters).where("n > 0").drop("n_late")).withColumnRenamed("n", "n_events")


def p4_found(spark, folder: str) -> DataFrame:
    """Record ids of first deliveries that came more than 72 hours after their UTC day's end."""
    return late_deliveries(timeline_state(spark, folder)).select(F.col("tie").alias("record_id"))


def _dated(df: DataFrame) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")), "yyyy-MM-dd")
    return df.withColumn("day", day).withColumnRenamed("key", "publisher")


def p4_counts(spark, folder: str) -> DataFrame:
    """Events per UTC day and publisher after all corrections, and those that came too late to count."""
    return _dated(totals(timeline_state(spark, folder).counters)).withColumnRenamed("n", "n_events")


def p4_corrections(spark, folder: str) -> DataFrame:
    """Count per UTC day and publisher as the first feed alone gave it and as the second left it."""
    rows = timeline_state(spark, folder).counters
    first = rows.where("version = 1").groupBy("day", "key").agg(F.sum("n").alias("n_first"))
    last = totals(rows).select(F.col("day").alias("d"), F.col("key").alias("k"), F.col("n").alias("n_last"))
    both = first.join(last, (F.col("day") == F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "full")
    return _dated(both.select(F.coalesce("day", "d").alias("day"), F.coalesce("key", "k").alias("key"), F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_last", F.lit(0)).alias("n_last")))
