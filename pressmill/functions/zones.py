"""Zone-offset intervals of the public time-zone database."""

from __future__ import annotations

import re
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_TABLES: dict[str, DataFrame] = {}
FIRST_YEAR = 1800
"""Before it no zone changes: earlier times are looked up at its start."""
RULE_YEAR = 2090
"""From here on every zone follows its last rule, and the calendar repeats every 400 years."""
CYCLE = 400
CYCLE_SECONDS = 146_097 * 86400
BLOCK_SECONDS = 20 * 31_556_952
"""Of a row of the interval table: twenty mean years."""
_SPAN = (-(2**62), 2**62)


def _second(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


def _content(name: str) -> bytes:
    """The compiled rules of a zone, from the system's database or the packaged one."""
    for root in zoneinfo.TZPATH:
        path = Path(root) / name
        if path.is_file():
            return path.read_bytes()
    return resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()


def _listed_changes(content: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Offset before all changes and (second, offset after) of the changes that a compiled file (RFC 8536) lists."""

    def header(at: int) -> tuple:
        return struct.unpack(">6I", content[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = header(0)
    at, wide, form = 44, 4, "l"
    if content[4:5] >= b"2":  # a second block with 64-bit times follows the first
        skip = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        isut, isstd, leap, times, types, chars = header(skip)
        at, wide, form = skip + 44, 8, "q"
    moments = struct.unpack(f">{times}{form}", content[at : at + times * wide])
    kinds = content[at + times * wide : at + times * (wide + 1)]
    base = at + times * (wide + 1)
    offsets = [struct.unpack(">lBB", content[base + 6 * k : base + 6 * k + 6])[0] for k in range(types)]
    return offsets[0], [(m, offsets[k]) for m, k in zip(moments, kinds, strict=True)]


_FOOTER = re.compile(
    r"(?:[A-Za-z]{3,}|<[^>]+>)([+-]?[\d:]+)(?:(?:[A-Za-z]{3,}|<[^>]+>)([+-]?[\d:]+)?,M(\d+)\.(\d)\.(\d)(?:/([+-]?[\d:]+))?,M(\d+)\.(\d)\.(\d)(?:/([+-]?[\d:]+))?)?"
)


def _clock(text: str) -> int:
    """Seconds of hours[:minutes[:seconds]] with a sign."""
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return (-1 if text.startswith("-") else 1) * sum(n * unit for n, unit in zip(parts, (3600, 60, 1), strict=False))


def _nth_weekday(year: int, month: int, week: int, weekday: int) -> int:
    """Second of the midnight that begins the week-th such weekday (0 is Sunday) of a month, the last one for 5."""
    first = datetime(year, month, 1, tzinfo=timezone.utc)
    day = 1 + (weekday - first.isoweekday()) % 7 + 7 * (week - 1)
    longest = ((first + timedelta(days=31)).replace(day=1) - first).days
    return int(first.timestamp()) + (day - 1 - (7 if day > longest else 0)) * 86400


def _ruled_changes(footer: str, first_year: int, stop_year: int) -> list[tuple[int, int]]:
    """(second, offset after) of the yearly changes that a file's closing rule states (POSIX TZ text; weekday rules, which all zones use)."""
    m = _FOOTER.fullmatch(footer)
    if footer and not m:
        raise ValueError(f"unknown rule {footer!r}")
    if not m or not m[3]:
        return []
    plain = -_clock(m[1])
    summer = -_clock(m[2]) if m[2] else plain + 3600
    start, end = [int(x) for x in m.group(3, 4, 5)], [int(x) for x in m.group(7, 8, 9)]
    start_clock, end_clock = _clock(m[6] or "2"), _clock(m[10] or "2")
    out = []
    for year in range(first_year, stop_year):
        out.append((_nth_weekday(year, *start) + start_clock - plain, summer))
        out.append((_nth_weekday(year, *end) + end_clock - summer, plain))
    return sorted(out)


@lru_cache(maxsize=None)
def _intervals(content: bytes) -> tuple[tuple[int, int, int], ...]:
    offset, changes = _listed_changes(content)
    last = changes[-1][0] if changes else _second(1970)
    footer = content.rstrip(b"\n").rpartition(b"\n")[2].decode("ascii", "replace")
    year = max(1970, (_EPOCH + timedelta(seconds=last)).year)
    changes += [c for c in _ruled_changes(footer, year, RULE_YEAR + CYCLE + 1) if c[0] > last]
    out, begin = [], _SPAN[0]
    for moment, new in changes:
        if new != offset and moment > begin:
            out.append((begin, moment, offset))
            begin, offset = moment, new
    return (*out, (begin, _SPAN[1], offset))


def zone_intervals(name: str) -> tuple[tuple[int, int, int], ...]:
    """(start, end, offset) in UTC seconds, half open, from the beginning of time to the end of the cycle."""
    return _intervals(_content(name))


@lru_cache(maxsize=1)
def _rows() -> tuple:
    rows = []
    blocks = [(b, b * BLOCK_SECONDS, (b + 1) * BLOCK_SECONDS) for b in range(_second(FIRST_YEAR) // BLOCK_SECONDS, _second(RULE_YEAR + CYCLE) // BLOCK_SECONDS + 1)]
    made: dict[tuple, list] = {}
    for name in sorted(zoneinfo.available_timezones()):
        try:
            spans = zone_intervals(name)
        except (OSError, ValueError, struct.error):
            continue
        if spans not in made:
            local = [(begin + offset, end + offset, offset) for begin, end, offset in spans]
            made[spans] = [(block, *(list(x) for x in zip(*[s for s in local if s[0] < high and s[1] > low], strict=True))) for block, low, high in blocks]
        rows += [(name, *row) for row in made[spans]]
    return tuple(rows)


def exploded_intervals(spark: SparkSession) -> DataFrame:
    """One row per (zone, block of local time): the local-time intervals that touch the block and their offsets.

    Local intervals of one zone overlap where clocks go back and leave a hole where
    they go forward, so the number of intervals holding a local time tells whether it
    is ambiguous, nonexistent or determined. The table's size is fixed by the public
    database (about 600 names times 36 blocks), whatever the data.
    """
    key = spark.sparkContext.applicationId
    if key not in _TABLES:  # one relation per application, so that plans with several lookups share its broadcast
        schema = "zone string, zone_block int, zone_from array<bigint>, zone_until array<bigint>, zone_offset array<int>"
        _TABLES[key] = spark.createDataFrame(list(_rows()), schema)
    return _TABLES[key]


def table_second(local: Column) -> Column:
    """The second at which a local time is looked up: itself, or where the table does not reach, a time under the same rule.

    Times after the cycle are moved back by whole cycles; times before the first year stand at its start.
    """
    start = _second(RULE_YEAR)
    cycles = F.greatest(F.lit(0).cast("bigint"), F.floor((local - start) / CYCLE_SECONDS))
    return F.greatest(F.lit(_second(FIRST_YEAR)), local - cycles * CYCLE_SECONDS)
