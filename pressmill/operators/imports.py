"""Validation of imported collections: a closed, versioned format, every error reported at once.

The format is a table of field rules; ``errors_of`` walks a parsed body by it and yields
(path, message) in document order, group rules last. ``validate`` runs it over a column
of JSON bodies, one body per row; ``body_errors`` is the same for one body in Python.

Deviations from looser readings, on purpose: the version must be the integer 1, not true
or 1.0; patterns must match to the very end, so a trailing line feed fails.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from datetime import date, datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.urls import safe
from pressmill.shared import ship

VERSION = 1
MAX_BYTES = 1_048_576
# Fixed values of the format: limits in characters or entries.
ARTICLES, NOTES, CONTEXT = (1, 500), 50, 10
RELEVANCE = ("related", "unrelated", "uncertain")
DUPLICATE = ("confirmed", "possible", "unassessed")
# Field rules: kind, limit, required. Kinds: text, slug, word, url, choice, flag, claim, count, day, list, object.
TOP = {
    "schema_version": ("version", 0, True), "id": ("slug", 0, True), "title": ("text", 200, True), "topic": ("text", 80, True), "description": ("text", 1000, False),
    "story_label": ("text", 60, False), "coverage_status": ("text", 200, False), "kicker": ("text", 60, False), "aggregate_context": ("context", 0, False),
    "articles": ("articles", 0, True), "uncertainties": ("notes", 0, False), "timeline_notes": ("timeline", 0, False),
}
CONTEXT_FIELDS = {"count": ("count", 0, True), "date": ("day", 0, True), "language": ("text", 40, True), "source": ("text", 1000, True), "meaning": ("text", 1000, True)}
ARTICLE = {
    "id": ("slug", 0, True), "title": ("text", 200, True), "publisher": ("text", 120, True), "language": ("word", 40, True), "url": ("url", 2048, False), "origin_label": ("free", 120, False),
    "publisher_visible_timestamp": ("free", 1000, False), "scope_notes": ("free", 1000, False), "syndication_assessment": ("free", 1000, False),
    "reported_event_timestamps_and_uncertainty": ("free", 1000, False), "relevance": ("relevance", 0, True), "inspected": ("flag", 0, False), "duplicate_group": ("free", 120, False),
    "duplicate_status": ("duplicate", 0, False), "claimed_timestamp": ("claim", 0, False), "excerpt": ("free", 2000, False), "include_in_replay": ("flag", 0, False),
}
NOTE = {"id": ("slug", 0, True), "title": ("text", 200, True), "detail": ("text", 1000, True), "source_ids": ("refs", 0, True)}
TIMELINE = {"context": ("strings", 300, False), "date_axis_meaning": ("free", 1000, False), "empty_interval_meaning": ("free", 1000, False)}
CLAIM = {"value": ("free", 0, True), "precision": ("free", 0, True)}
_SLUG, _WORD, _DAY = re.compile(r"[a-z0-9][a-z0-9_-]{2,63}"), re.compile(r"[a-z]+"), re.compile(r"\d{4}-\d{2}-\d{2}")
_UNREADABLE = object()
Error = tuple[str, str]


def safe_url(value: str) -> bool:
    try:
        parts = urlsplit(value)
        return parts.scheme in ("http", "https") and bool(parts.hostname) and "@" not in parts.netloc
    except ValueError:
        return False


def claim_errors(raw, path: str) -> Iterator[Error]:
    """A day under date precision; a time with an explicit offset under datetime."""
    if not isinstance(raw, dict):
        yield path, "must be an object"
        return
    yield from unknown(raw, CLAIM, path)
    value, precision = raw.get("value"), raw.get("precision")
    if value is None:
        yield f"{path}.value", "required"
    elif not isinstance(value, str):
        yield f"{path}.value", "must be a string"
    if precision not in ("date", "datetime"):
        yield f"{path}.precision", 'must be "date" or "datetime"'
    elif isinstance(value, str) and precision == "date":
        if not _DAY.fullmatch(value):
            yield f"{path}.value", "date precision requires YYYY-MM-DD without a time"
        else:
            try:
                date.fromisoformat(value)
            except ValueError:
                yield f"{path}.value", "not a real calendar date"
    elif isinstance(value, str):
        try:
            moment = datetime.fromisoformat(value)
        except ValueError:
            yield f"{path}.value", "not a valid ISO 8601 datetime"
        else:
            if moment.tzinfo is None:
                yield f"{path}.value", "datetime precision requires an explicit UTC offset"


def unknown(obj: dict, fields: dict, path: str) -> Iterator[Error]:
    for key in sorted(set(obj) - set(fields)):
        yield (f"{path}.{key}" if path else key), "unknown field"


def _text(value, limit: int, path: str, blank: bool) -> Iterator[Error]:
    if not isinstance(value, str) or (not blank and not value.strip()):
        yield path, "must be a string" if blank else "must be a non-empty string"
    elif len(value) > limit > 0:
        yield path, f"exceeds {limit} characters"


def _pattern(value, pattern: re.Pattern, path: str, message: str) -> Iterator[Error]:
    if not (isinstance(value, str) and pattern.fullmatch(value)):
        yield path, message


def value_errors(kind: str, limit: int, value, path: str) -> Iterator[Error]:
    """Errors of one present value by the rule of its kind."""
    match kind:
        case "version":
            if type(value) is not int or value != VERSION:
                yield path, f"must equal {VERSION}"
        case "slug":
            yield from _pattern(value, _SLUG, path, "must match [a-z0-9][a-z0-9_-]{2,63}")
        case "word":
            first = list(_text(value, limit, path, False))
            yield from first
            if not first:
                yield from _pattern(value, _WORD, path, 'must be a lowercase word like "english"')
        case "text":
            yield from _text(value, limit, path, False)
        case "free":
            yield from _text(value, limit, path, True)
        case "url":
            if not isinstance(value, str):
                yield path, "must be a string"
                return
            yield from _text(value, limit, path, True)
            if not safe_url(value):
                yield path, "invalid or unsafe URL scheme; http or https with a host and no user"
        case "relevance" | "duplicate":
            options = RELEVANCE if kind == "relevance" else DUPLICATE
            if value not in options:
                yield path, f"must be one of {', '.join(options)}"
        case "flag":
            if not isinstance(value, bool):
                yield path, "must be true or false"
        case "count":
            if type(value) is not int or value < 0:
                yield path, "must be an integer >= 0"
        case "day":  # the form only: the format does not ask whether the day exists
            yield from _pattern(value, _DAY, path, "must match YYYY-MM-DD")
        case "claim":
            yield from claim_errors(value, path)
        case "context":
            yield from object_errors(value, CONTEXT_FIELDS, path)
        case "timeline":
            yield from object_errors(value, TIMELINE, path)
        case "strings":
            if not isinstance(value, list):
                yield path, "must be a list of strings"
            elif len(value) > CONTEXT:
                yield path, f"at most {CONTEXT} items"
            else:
                for i, item in enumerate(value):
                    yield from _text(item, limit, f"{path}[{i}]", False)
        case "refs":
            if not isinstance(value, list) or not value:
                yield path, "must be a non-empty list of article ids"


def object_errors(obj, fields: dict, path: str) -> Iterator[Error]:
    if not isinstance(obj, dict):
        yield path, "must be an object"
        return
    yield from unknown(obj, fields, path)
    for name, (kind, limit, required) in fields.items():
        at = f"{path}.{name}" if path else name
        # an explicit null is a wrong flag or status, and an absent value elsewhere
        if name not in obj or (obj[name] is None and kind not in ("flag", "duplicate")):
            if required:
                yield at, "required"
        elif kind not in ("articles", "notes"):
            yield from value_errors(kind, limit, obj[name], at)


def _repeats(items: list, path: str, what: str) -> dict[int, Error]:
    seen, out = set(), {}
    for i, item in enumerate(items):
        key = item.get("id") if isinstance(item, dict) else None
        if isinstance(key, str):
            if key in seen:
                out[i] = (f"{path}[{i}].id", f"duplicate {what} id {key!r}")
            seen.add(key)
    return out


def article_errors(raw) -> Iterator[Error]:
    if raw is None:
        return
    if not isinstance(raw, list):
        yield "articles", "must be a list"
        return
    if not ARTICLES[0] <= len(raw) <= ARTICLES[1]:
        yield "articles", f"must contain {ARTICLES[0]}..{ARTICLES[1]} entries"
        return
    repeats = _repeats(raw, "articles", "article")
    for i, item in enumerate(raw):
        path = f"articles[{i}]"
        if i in repeats:
            yield repeats[i]
        yield from object_errors(item, ARTICLE, path)
        if isinstance(item, dict) and item.get("include_in_replay") is True and item.get("claimed_timestamp") is None:
            yield f"{path}.include_in_replay", "true requires claimed_timestamp"
    items = [(i, x) for i, x in enumerate(raw) if isinstance(x, dict) and isinstance(x.get("duplicate_group"), str)]
    members = Counter(x["duplicate_group"] for _, x in items)
    states: dict[str, set] = {}
    for _, x in items:
        states.setdefault(x["duplicate_group"], set()).add(x.get("duplicate_status") == "confirmed")
    for i, x in items:
        if x.get("duplicate_status") == "confirmed" and members[x["duplicate_group"]] < 2:
            yield f"articles[{i}].duplicate_status", '"confirmed" requires at least 2 articles sharing duplicate_group'
    for group in sorted(g for g, s in states.items() if len(s) > 1):
        yield "articles", f'duplicate_group {group!r} mixes "confirmed" and other statuses'


def note_errors(raw, articles) -> Iterator[Error]:
    if raw is None:
        return
    if not isinstance(raw, list):
        yield "uncertainties", "must be a list"
        return
    if len(raw) > NOTES:
        yield "uncertainties", f"at most {NOTES} entries"
        return
    known = {x["id"] for x in articles if isinstance(x, dict) and isinstance(x.get("id"), str)} if isinstance(articles, list) else set()
    repeats = _repeats(raw, "uncertainties", "uncertainty")
    for i, item in enumerate(raw):
        path = f"uncertainties[{i}]"
        if i in repeats:
            yield repeats[i]
        yield from object_errors(item, NOTE, path)
        refs = item.get("source_ids") if isinstance(item, dict) else None
        for ref in refs if isinstance(refs, list) else []:
            if not isinstance(ref, str) or ref not in known:
                yield f"{path}.source_ids", f"unknown article id {ref!r}"


def errors_of(body) -> Iterator[Error]:
    if not isinstance(body, dict):
        yield "body", "must be a JSON object"
        return
    yield from object_errors(body, TOP, "")
    yield from article_errors(body.get("articles"))
    yield from note_errors(body.get("uncertainties"), body.get("articles"))


def body_errors(text: str | bytes | None) -> list[Error]:
    """All errors of one body, in order; a body that is too large or no JSON has that one."""
    raw = text.encode() if isinstance(text, str) else text or b""
    if len(raw) > MAX_BYTES:
        return [("body", f"exceeds {MAX_BYTES} bytes")]
    try:
        body = json.loads(raw.decode("utf-8", "replace"))
    except ValueError:
        return [("body", "not valid JSON")]
    return list(errors_of(body))


def validate(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ordinal, path, message): a row per error; valid bodies give none."""
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<path:string,message:string>>")
    def check(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"path": p, "message": m} for p, m in body_errors(b)])

    rows = df.select(key, F.posexplode(check(body)).alias("ordinal", "e"))
    return rows.select(key, "ordinal", "e.path", "e.message")


# A time with its offset in fields that can exist; whether the day does, the parser says.
_MOMENT = r"\A\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)\z"


def column_errors(rows: DataFrame) -> DataFrame:
    """The same rules as column expressions over articles that are already rows: record_id, rule, message."""
    value, precision = F.col("claimed_timestamp.value"), F.col("claimed_timestamp.precision")
    group = F.coalesce("duplicate_group", F.concat(F.lit("UNASSESSED-"), "id"))
    members = rows.groupBy("investigation_id", group.alias("g")).agg(F.count("*").alias("members"))
    rows = rows.withColumn("g", group).join(members, ["investigation_id", "g"], "left")
    copies = rows.groupBy("investigation_id", "id").agg(F.min("record_id").alias("first_record"))
    rows = rows.join(copies, ["investigation_id", "id"], "left")
    rule = lambda name, bad, message: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message")))
    rules = [
        rule("id", F.col("id").isNull() | ~F.col("id").rlike(r"\A[a-z0-9][a-z0-9_-]{2,63}\z"), "bad slug"),
        rule("id_repeated", F.col("record_id") > F.col("first_record"), "duplicate article id"),
        rule("title", F.col("title").isNull() | (F.trim("title") == ""), "required"),
        rule("title_long", F.char_length("title") > 200, "exceeds 200 characters"),
        rule("publisher", F.col("publisher").isNull() | (F.trim("publisher") == ""), "required"),
        rule("publisher_long", F.char_length("publisher") > 120, "exceeds 120 characters"),
        rule("language", F.col("language").isNull() | ~F.col("language").rlike(r"\A[a-z]{1,40}\z"), "must be a lowercase word"),
        rule("url", F.col("url").isNotNull() & safe(F.col("url")).isNull(), "unsafe address"),
        rule("relevance", F.col("relevance").isNull() | ~F.col("relevance").isin(*RELEVANCE), "must be one of the three"),
        rule("duplicate_status", ~F.col("duplicate_status").isin(*DUPLICATE), "must be one of the three"),
        rule("confirmed_group", (F.col("duplicate_status") == "confirmed") & (F.col("members") < 2), "needs two articles"),
        rule("excerpt_long", F.char_length("excerpt") > 2000, "exceeds 2000 characters"),
        rule("replay", F.col("include_in_replay") & F.col("claimed_timestamp").isNull(), "replay requires a claimed time"),
        rule("precision", F.col("claimed_timestamp").isNotNull() & (precision.isNull() | ~precision.isin("date", "datetime")), "must be date or datetime"),
        rule("date_value", (precision == "date") & (~value.rlike(r"\A\d{4}-\d{2}-\d{2}\z") | F.try_to_date(value, "yyyy-MM-dd").isNull()), "date precision needs a day"),
        rule("datetime_value", (precision == "datetime") & (~value.rlike(_MOMENT) | F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNull()), "needs an explicit offset"),
    ]
    found = rows.select("record_id", F.explode(F.array_compact(F.array(*rules))).alias("e"))
    return found.select("record_id", "e.rule", "e.message")
