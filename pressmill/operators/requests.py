"""Operations on request logs: headers, retries, newest answers, addresses with several keys, review packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header_value(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name; the first in name order if several match."""
    found = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower()))
    return F.get(F.array_sort(found), F.lit(0))


def may_retry(status: Column, attempts: Column, bytes_held: Column, most_attempts: int = 2) -> Column:
    """Technical failures only: no answer or a server error, tries left, nothing held; refusals and gone pages are answers."""
    technical = status.isNull() | (status >= 500) | (status == 429)
    return technical & (F.coalesce(attempts, F.lit(0)) < most_attempts) & (F.coalesce(bytes_held, F.lit(0)) == 0)


def newest_per_key(rows: DataFrame, key: str, attempt: str) -> DataFrame:
    """The last attempt of each request, whatever its outcome: failures are answers too."""
    rest = [c for c in rows.columns if c not in (key, attempt)]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(attempt, *rest)).alias("r"))
    return last.select(key, "r.*")


def match_any_key(left: DataFrame, left_id: str, left_keys: list[Column], right: DataFrame, right_id: str, right_keys: list[Column]) -> DataFrame:
    """Pairs of ids that share one of several keys: both key sets become rows and meet in an equi-join."""
    a = left.select(F.col(left_id).alias("a"), F.explode(F.array_distinct(F.array_compact(F.array(*left_keys)))).alias("k"))
    b = right.select(F.col(right_id).alias("b"), F.explode(F.array_distinct(F.array_compact(F.array(*right_keys)))).alias("k"))
    return a.join(b, "k").select("a", "b").distinct()


def review_packets(rows: DataFrame, key: str, text: str, most: int = 7000) -> DataFrame:
    """The text of each packet that a reviewer reads, cut to ``most`` characters, which is what a packet is."""
    return rows.select(key, F.substring(text, 1, most).alias("packet"), (F.char_length(text) > most).alias("cut"))
