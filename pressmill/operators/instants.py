"""Written times of many forms brought to one UTC instant, or left unknown.

``normalise_instants`` parses each value into local date and clock fields with JVM
expressions, takes an offset that the value states, and resolves region names by an
as-of join of the local time to exploded zone-offset intervals: two intervals that
hold the local time mean it is ambiguous, none means it never occurred, one gives
the offset.

Defined results (column ``status``):
  null or blank value -> ``missing``; text of no known form -> ``unreadable``;
  a date without clock -> ``no_time``; a clock without any zone -> ``no_zone``;
  impossible date or clock -> ``impossible``; a numeric date whose day and month can
  be swapped for another date -> ``swappable``; a zone that is not in the database
  -> ``unknown_zone``; repeated and skipped local times -> ``ambiguous`` and
  ``nonexistent``; otherwise ``resolved`` with ``epoch_second`` set.
The number of rows never changes, repeated rows are treated alike, an empty table
gives an empty result, and only the named struct column is added, so other columns may
have any name.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.zones import BLOCK_SECONDS, exploded_intervals, table_second

# Month names of the six languages the engine meets, full and short forms.
MONTHS = {
    1: "january jan enero ene januar jänner janvier janv января",
    2: "february feb febrero februar février fevrier févr февраля",
    3: "march mar marzo märz maerz mrz mars марта",
    4: "april apr abril abr avril avr апреля",
    5: "may mayo mai мая",
    6: "june jun junio juni juin июня",
    7: "july jul julio juli juillet juil июля",
    8: "august aug agosto ago août aout августа",
    9: "september sep sept septiembre set septembre сентября",
    10: "october oct octubre oktober okt octobre октября",
    11: "november nov noviembre novembre ноября",
    12: "december dec diciembre dic dezember dez décembre decembre déc декабря",
}
# Fixed offsets of zone abbreviations, in minutes. IST and other names with several meanings are left out.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240,
    "ADT": -180, "BRT": -180, "ART": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_TAIL = r"\s*(?:h|Uhr)?\s*([AaPp]\.?[Mm]\b\.?)?\s*[\[(]?\s*([^\]()\[]*?)\s*[\])]?"
_WORD = r"([\p{L}]{3,}\.?)"
_DAY = r"(?:[\p{L}]{2,}\.?,?\s+)?"
# Each pattern yields year|month|day|hour|minute|second|half|zone.
FORMS = {
    "iso": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_TAIL}$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?\s*(\S*)$", "$1|$2|$3|$4|$5|$6||$7"),
    "numeric": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}),?\s+{_CLOCK}{_TAIL}$", "$4|$3|$1|$5|$6|$7|$8|$9"),
    "month_first": (rf"^{_DAY}{_WORD}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_TAIL}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    "day_first": (
        rf"^{_DAY}(\d{{1,2}})\.?\s+(?:de\s+)?{_WORD}\s+(?:de\s+)?(\d{{4}}),?\s+(?:à\s+|at\s+|um\s+|a las\s+)?"
        rf"(\d{{1,2}})\s*[:hH]\s*(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?{_TAIL}$",
        "$3|$2|$1|$4|$5|$6|$7|$8",
    ),
    "ideographic": (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*{_CLOCK}{_TAIL}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    "digits": (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6||"),
}
_DATE_ONLY = (
    r"^(\d{4}|\d{4}[-/.]\d{1,2}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{8}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|"
    r"\d{4}年\d{1,2}月(\d{1,2}日)?|(\d{1,2}\.?\s+)?(de\s+)?\p{L}{3,}\.?\s+(\d{1,2},?\s+)?(de\s+)?\d{4})$"
)
_OFFSET = r"^(?:UTC|GMT)?\s*([+\-−])(\d{1,2})(?::?(\d{2}))?$"
_REGION = r"^[A-Za-z][A-Za-z0-9_+\-]*(?:/[A-Za-z0-9_+\-]+){0,2}$"
_REGION_IN_TEXT = r"(?<![\w/])([A-Z][A-Za-z]+(?:/[A-Z](?:[A-Za-z0-9_+\-]*[A-Za-z0-9])?){1,2})"


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _form_and_fields(text: Column) -> tuple[Column, Column]:
    """The name of the form that ``text`` has, and its fields joined by '|' once the form stands in ``_form``."""
    form, fields = F.when(text.rlike(r"^(\d{10}|\d{13})$"), "epoch"), F.when(F.lit(False), text)
    for name, (pattern, template) in FORMS.items():
        form = form.when(text.rlike(pattern), name)
        fields = fields.when(F.col("_form") == name, F.regexp_replace(text, pattern, template))
    return form.when(text.rlike(_DATE_ONLY), "date"), fields


def normalise_instants(
    df: DataFrame,
    value: str | Column,
    hint: str | Column | None = None,
    bare_digits_utc: bool | Column = False,
    out: str = "instant",
) -> DataFrame:
    """Add struct ``out``: status, epoch_second, local_second, offset_second, zone_name, form.

    hint: free text that may name the region whose clock was used, for values that
    state no zone themselves. bare_digits_utc: whether fourteen digits without zone are UTC,
    for all rows or by a column.
    Any name of the database is a region, in any year; what no zone's rules say is ``unknown_zone``.
    """
    if isinstance(value, str):
        value = F.col(value)
    if isinstance(hint, str):
        hint = F.col(hint)
    text = F.regexp_replace(value.cast("string"), r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", "")
    form, fields = _form_and_fields(F.col("_t"))
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    step = df.select(kept, text.alias("_t"), (hint if hint is not None else F.lit(None).cast("string")).alias("_h"), (F.lit(bare_digits_utc) if isinstance(bare_digits_utc, bool) else bare_digits_utc).alias("_b"))
    step = step.withColumn("_form", form).withColumn("_p", F.split(fields, r"\|"))
    part = lambda k: F.element_at(F.col("_p"), k)
    number = lambda k: F.when(part(k).rlike(r"^\d+$"), part(k).cast("int"))
    month_names = {n: m for m, names in MONTHS.items() for n in names.split()}
    a, b = number(2), number(3)
    numeric = F.col("_form") == "numeric"
    month = F.when(part(2).rlike(r"^\d+$"), F.when(numeric & (a > 12) & (b <= 12), b).otherwise(a)).otherwise(
        _literal_map(month_names)[F.lower(F.rtrim(part(2), F.lit(".")))]
    )
    day = F.when(numeric & (a > 12) & (b <= 12), a).otherwise(b)
    half = F.upper(F.substring(part(7), 1, 1))
    zone = F.coalesce(part(8), F.lit(""))
    step = step.select(
        "_row", "_t", "_h", "_b", F.col("_form").alias("form"), number(1).alias("y"), month.alias("m"), day.alias("d"),
        number(4).alias("h"), number(5).alias("mi"), F.coalesce(number(6), F.lit(0)).alias("s"), half.alias("half"), zone.alias("z"),
        (numeric & (a <= 12) & (b <= 12) & (a != b)).alias("swap"),
    )
    leap = ((F.col("y") % 4 == 0) & (F.col("y") % 100 != 0)) | (F.col("y") % 400 == 0)
    longest = (
        F.when(F.col("m").isin(4, 6, 9, 11), 30).when((F.col("m") == 2) & leap, 29).when(F.col("m") == 2, 28).otherwise(31)
    )
    hour = F.when(F.col("half") == "", F.col("h")).when(F.col("h").between(1, 12), F.col("h") % 12 + F.when(F.col("half") == "P", 12).otherwise(0))
    possible = F.coalesce(
        F.col("y").between(1000, 9999) & F.col("m").between(1, 12) & (F.col("d") >= 1) & (F.col("d") <= longest)
        & hour.between(0, 23) & F.col("mi").between(0, 59) & F.col("s").between(0, 59), F.lit(False),
    )
    local = F.when(
        possible,
        F.datediff(F.make_date("y", "m", "d"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
        + hour * 3600 + F.col("mi") * 60 + F.col("s"),
    )
    sign = F.regexp_extract("z", _OFFSET, 1)
    hours, minutes = F.regexp_extract("z", _OFFSET, 2), F.regexp_extract("z", _OFFSET, 3)
    stated = F.when(
        F.col("z").rlike(_OFFSET),
        F.when(
            (hours.cast("int") <= 18) & (F.coalesce(F.when(minutes != "", minutes.cast("int")), F.lit(0)) < 60),
            F.when(sign == "+", 1).otherwise(-1)
            * (hours.cast("int") * 3600 + F.coalesce(F.when(minutes != "", minutes.cast("int")), F.lit(0)) * 60),
        ),
    ).otherwise(_literal_map({k: v * 60 for k, v in ABBREVIATIONS.items()})[F.upper("z")])
    if bare_digits_utc is not False:
        stated = F.when((F.col("form") == "digits") & F.col("_b"), 0).otherwise(stated)
    hinted = F.regexp_extract("_h", _REGION_IN_TEXT, 1)
    region = F.when(stated.isNotNull(), None).when(F.col("z").rlike(_REGION), F.col("z")).when((F.col("z") == "") & (hinted != ""), hinted)
    stamp = F.when(F.col("form") == "epoch", F.when(F.length("_t") == 13, F.substring("_t", 1, 10)).otherwise(F.col("_t")).cast("bigint"))
    step = step.select("_row", "_t", "form", "z", "swap", stamp.alias("stamp"), local.alias("local"), stated.alias("stated"), region.alias("region"))
    wanted = F.when(F.col("local").isNotNull(), F.col("region"))
    step = step.withColumn("_zone", wanted).withColumn("_at", F.when(F.col("_zone").isNotNull(), table_second(F.col("local"))))
    block = F.floor(F.col("_at") / BLOCK_SECONDS).cast("int")
    spans = F.broadcast(exploded_intervals(df.sparkSession))
    step = step.withColumn("_block", block).join(spans, (F.col("_zone") == F.col("zone")) & (F.col("_block") == F.col("zone_block")), "left")
    # the as-of condition over the joined intervals: each that holds the local time
    holding = F.filter(
        F.arrays_zip("zone_from", "zone_until", "zone_offset"),
        lambda x: (x["zone_from"] <= F.col("_at")) & (F.col("_at") < x["zone_until"]),
    )
    step = step.withColumn("_held", F.when(F.col("zone").isNotNull(), holding))
    held = F.size("_held")
    status = (
        F.when(F.col("_t").isNull() | (F.col("_t") == ""), "missing")
        .when(F.col("form").isNull(), "unreadable")
        .when(F.col("stamp").isNotNull(), "resolved")
        .when(F.col("form") == "date", "no_time")
        .when(F.col("local").isNull(), "impossible")
        .when(F.col("swap"), "swappable")
        .when(F.col("stated").isNotNull(), "resolved")
        .when(F.col("region").isNull() & (F.col("z") == ""), "no_zone")
        .when(F.col("_held").isNull(), "unknown_zone")
        .when(held > 1, "ambiguous")
        .when(held == 0, "nonexistent")
        .otherwise("resolved")
    )
    offset = F.coalesce(F.col("stated"), F.when(held == 1, F.element_at(F.col("_held"), 1)["zone_offset"]))
    step = step.withColumn("_status", status)
    second = F.when(F.col("_status") == "resolved", F.coalesce(F.col("stamp"), F.col("local") - offset))
    made = F.struct(
        F.col("_status").alias("status"), second.alias("epoch_second"), F.col("local").alias("local_second"),
        offset.alias("offset_second"), F.col("region").alias("zone_name"), F.col("form"),
    )
    return step.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], made.alias(out))


def iso_utc(second: Column) -> Column:
    """``YYYY-MM-DDThh:mm:ssZ`` of a second since 1970, whatever the session's zone."""
    days = F.floor(second / 86400).cast("int")
    rest = second - days.cast("bigint") * 86400
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd"), F.lit("T"),
        two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"),
    )


#: How the three sources of written times write them when all is well.
USUAL_CLAIM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00\z"
USUAL_SEEN = r"^\d{8}T\d{6}Z\z"


def written_instants(spark, folder: str) -> DataFrame:
    """(src_table, record_id, written, usual_form, instant) of all written times of the three tables."""
    from pressmill.tables import table

    def side(name: str, written: Column, hint: Column, usual: str, digits: bool) -> DataFrame:
        rows = table(spark, folder, name).select(F.lit(name).alias("src_table"), "record_id", written.alias("written"), hint.alias("hint"), written.rlike(usual).alias("usual_form"), F.lit(digits).alias("digits"))
        return rows.where("written is not null")

    none = F.lit(None).cast("string")
    rows = side("timeline_data", F.col("publisher_publication_utc_claim"), F.col("precision"), USUAL_CLAIM, False)
    rows = rows.unionAll(side("synthetic_investigation", F.col("claimed_timestamp.value"), none, USUAL_CLAIM, False)).unionAll(side("evidence_sources", F.col("seendate"), none, USUAL_SEEN, True))
    return normalise_instants(rows, "written", "hint", bare_digits_utc=F.col("digits")).drop("hint", "digits")


def p2_found(spark, folder: str) -> DataFrame:
    """Values that determine one instant without being written in the usual form."""
    found = written_instants(spark, folder).where(~F.col("usual_form") & (F.col("instant.status") == "resolved"))
    return found.select("src_table", "record_id", iso_utc(F.col("instant.epoch_second")).alias("utc_instant"))


def p2_status(spark, folder: str) -> DataFrame:
    """How many values of each table and form end in which status."""
    rows = written_instants(spark, folder)
    return rows.groupBy("src_table", "usual_form", F.col("instant.form").alias("form"), F.col("instant.status").alias("status")).agg(F.count("*").alias("n_values"))
