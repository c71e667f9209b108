"""Queries over saved pages, records of several lines, greedy samples and import validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import html as H
from pressmill.functions import urls as U
from pressmill.operators import imports, sampling
from pressmill.shared import ship
from pressmill.sources import files
from pressmill.tables import table


def _pages(spark, folder: str) -> DataFrame:
    """A saved page written around every document: head, metas, JSON-LD, hidden parts, paragraphs."""
    ship(spark)
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", "url", "text", _written().alias("html"))


def _written() -> Column:
    escape = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    day = F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    other = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.lit("https://elsewhere.example/x").alias("url"), F.lit("2001-01-01").alias("datePublished")))
    own = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.concat("url", F.lit("#main")).alias("@id"), day.alias("datePublished")))
    graph = F.concat(F.lit('{"@graph":['), other, F.lit(","), own, F.lit("]}"))
    paragraphs = F.concat(F.lit("<p>"), F.array_join(F.split(escape(F.col("text")), r"\r?\n+", -1), "</p>\n<p>"), F.lit("</p>"))
    return F.concat(
        F.lit('<!doctype html><html lang="'), F.coalesce("lang", F.lit("und")), F.lit('"><head><title>'), escape(F.coalesce("topic", F.lit(""))), F.lit("</title><style>p{color:red}</style>"),
        F.lit('<meta property="og:type" content="article"><meta property="article:published_time" content="'), F.coalesce(day, F.lit("")), F.lit('"><script type="application/ld+json">'),
        F.coalesce(graph, F.lit("{}")), F.lit("</script></head><body><noscript>no script</noscript><article>"), paragraphs, F.lit("</article></body></html>"),
    )


def visible_text(spark, folder: str) -> DataFrame:
    """Visible text of every page: parts and digest."""
    shown = _pages(spark, folder).select("doc_id", H.visible_text("html").alias("shown"))
    return shown.select("doc_id", F.size(F.split("shown", "\n")).alias("n_parts"), F.char_length("shown").alias("n_chars"), F.md5("shown").alias("digest"))


def page_metadata(spark, folder: str) -> DataFrame:
    """Title, language, stated dates, article marks and body of every page."""
    read = _pages(spark, folder).select("doc_id", H.page_metadata("html").alias("m"))
    return read.select("doc_id", "m.title", "m.lang", "m.has_article", F.size("m.dates").alias("n_dates"), F.get("m.dates", F.lit(0))["value"].alias("first_date"), "m.blocks", F.char_length("m.body").alias("body_chars"))


def jsonld_dates(spark, folder: str) -> DataFrame:
    """Dates that a page's JSON-LD states of the page itself, with where they stand."""
    found = _pages(spark, folder).select("doc_id", F.explode(H.jsonld_dates("html", "url")).alias("d"))
    return found.select("doc_id", "d.field", "d.value", "d.location")


def historical_status(spark, folder: str) -> DataFrame:
    """Whether a page can be what a source saw: home page, published or modified after the sighting, plausible or unverified."""
    pages = table(spark, folder, "documents").select("doc_id", F.col("url").alias("final_url"), F.to_date("crawled_at").alias("modified"))
    seen = F.try_to_date(F.substring("seendate", 1, 8), "yyyyMMdd")
    rows = table(spark, folder, "evidence_sources").select("record_id", "doc_id", "url", F.when(F.col("seendate").rlike(r"^\d{8}T"), seen).alias("seen")).join(pages, "doc_id")
    status = (
        F.when(U.path(F.col("final_url")).isin("", "/"), "home page").when(F.date_diff("modified", "seen") > 2, "modified later")
        .when(U.host_key(F.col("url")) != U.host_key(F.col("final_url")), "host changed").when(F.col("seen").isNotNull() & F.col("modified").isNotNull(), "plausible").otherwise("unverified")
    )
    return rows.select("record_id", status.alias("status"))


def public_url(spark, folder: str) -> DataFrame:
    """Whether each distinct timeline address is public."""
    ship(spark)
    rows = table(spark, folder, "timeline_data").where("url is not null").select("url").distinct()
    return rows.select("url", H.public_url("url").alias("public"))


def wire_url(spark, folder: str) -> DataFrame:
    """Each distinct timeline address as it would be sent."""
    ship(spark)
    rows = table(spark, folder, "timeline_data").where("url is not null").select("url").distinct()
    return rows.select("url", H.wire_url("url").alias("sent"))


def record_reassembly(spark, folder: str) -> DataFrame:
    """Documents written as translated records with continuation lines, reassembled."""
    rows = table(spark, folder, "documents").where("text is not null")
    head = F.concat(F.lit("20260101000000-T"), F.col("doc_id").cast("string"), F.repeat(F.lit("\t"), F.lit(26)))
    body = F.regexp_replace(F.regexp_replace("text", "\t", " "), "\r\n", "\n")
    lines = rows.select("doc_id", F.posexplode(F.split(F.concat(head, body), "\n", -1)).alias("number", "line"))
    out = files.reassemble(lines, "doc_id", "number", "line", files.is_record_start(F.col("line")))
    return out.select("doc_id", "record", "continuations", "broken", F.md5(F.element_at(F.split("content", "\t", -1), -1)).alias("digest"))


def greedy_sample(spark, folder: str) -> DataFrame:
    """A capped sample of candidate pages: twelve of the first topics, four of the others, two per host."""
    rows = table(spark, folder, "evidence_sources").select("record_id", "topic", "url", U.host_key("url").alias("host"), U.identity(F.lower("url")).alias("identity"))
    quotas = {"shipping": 12, "energy": 12, "grain": 4, "rail": 4, "labour": 4, "insurance": 4, "semiconductors": 4}
    return sampling.greedy_sample(rows, "topic", "url", "host", "identity", "pressmill-1", quotas)


def import_validation(spark, folder: str) -> DataFrame:
    """Rule violations of the stored articles."""
    return imports.column_errors(table(spark, folder, "synthetic_investigation"))


def import_bodies(spark, folder: str) -> DataFrame:
    """Errors of every collection written as an import body, in order."""
    articles = table(spark, folder, "synthetic_investigation")
    fields = ["id", "title", "publisher", "language", "url", "relevance", "inspected", "duplicate_group", "duplicate_status", "claimed_timestamp", "excerpt", "include_in_replay"]
    listed = articles.groupBy("investigation_id").agg(F.array_sort(F.collect_list(F.struct("record_id", F.struct(*fields).alias("a")))).alias("l"))  # at most 500
    notes = table(spark, folder, "uncertainties").groupBy("investigation_id").agg(F.array_sort(F.collect_list(F.struct("id", "title", "detail", "source_ids"))).alias("uncertainties"))  # at most 50
    body = F.struct(F.lit(1).alias("schema_version"), F.col("investigation_id").alias("id"), F.lit("Collection").alias("title"), F.lit("mixed").alias("topic"), F.transform("l", lambda x: x["a"]).alias("articles"), "uncertainties")
    return imports.validate(listed.join(notes, "investigation_id", "left").select("investigation_id", F.to_json(body).alias("body")), "investigation_id", "body")


QUERIES = {
    f.__name__: f
    for f in (visible_text, page_metadata, jsonld_dates, historical_status, public_url, wire_url, record_reassembly, greedy_sample, import_validation, import_bodies)
}

_RULES = [
    ("id", r"id IS NULL OR NOT regexp_full_match(id, '[a-z0-9][a-z0-9_-]{2,63}')", "bad slug"),
    ("id_repeated", "record_id > first_record", "duplicate article id"),
    ("title", "title IS NULL OR trim(title, ' ') = ''", "required"),
    ("title_long", "length(title) > 200", "exceeds 200 characters"),
    ("publisher", "publisher IS NULL OR trim(publisher, ' ') = ''", "required"),
    ("publisher_long", "length(publisher) > 120", "exceeds 120 characters"),
    ("language", "language IS NULL OR NOT regexp_full_match(language, '[a-z]{1,40}')", "must be a lowercase word"),
    ("url", r"url IS NOT NULL AND NOT regexp_full_match(url, '(?i:https?)://[^/?#@:\s][^/?#@\s]*([/?#]\S*)?')", "unsafe address"),
    ("relevance", "relevance IS NULL OR relevance NOT IN ('related', 'unrelated', 'uncertain')", "must be one of the three"),
    ("duplicate_status", "duplicate_status NOT IN ('confirmed', 'possible', 'unassessed')", "must be one of the three"),
    ("confirmed_group", "duplicate_status = 'confirmed' AND members < 2", "needs two articles"),
    ("excerpt_long", "length(excerpt) > 2000", "exceeds 2000 characters"),
    ("replay", "include_in_replay AND claimed_timestamp IS NULL", "replay requires a claimed time"),
    ("precision", "claimed_timestamp IS NOT NULL AND (p IS NULL OR p NOT IN ('date', 'datetime'))", "must be date or datetime"),
    ("date_value", r"p = 'date' AND (NOT regexp_full_match(v, '\d{4}-\d{2}-\d{2}') OR try_cast(v AS DATE) IS NULL)", "date precision needs a day"),
    ("datetime_value", r"p = 'datetime' AND (NOT regexp_full_match(v, '\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)') OR try_cast(substr(v, 1, 10) AS DATE) IS NULL)", "needs an explicit offset"),
]
SQL = {
    "import_validation": """WITH b AS (SELECT *, claimed_timestamp.value AS v, claimed_timestamp.precision AS p, coalesce(duplicate_group, 'UNASSESSED-' || id) AS g FROM synthetic_investigation),
a AS (SELECT *, count(*) OVER (PARTITION BY investigation_id, g) AS members, min(record_id) OVER (PARTITION BY investigation_id, id) AS first_record FROM b)
"""
    + " UNION ALL ".join(f"SELECT record_id, '{rule}' AS rule, '{message}' AS message FROM a WHERE {bad}" for rule, bad, message in _RULES),
    "record_reassembly": """WITH l AS (SELECT doc_id, replace(replace(text, chr(9), ' '), chr(13) || chr(10), chr(10)) AS body FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 1::BIGINT AS record, length(body) - length(replace(body, chr(10), '')) AS continuations, false AS broken, md5(body) AS digest FROM l""",
    "historical_status": r"""WITH s AS (SELECT record_id, e.url, d.url AS final_url, CASE WHEN regexp_matches(seendate, '^\d{8}T') THEN try_strptime(substr(seendate, 1, 8), '%Y%m%d')::DATE END AS seen, crawled_at::DATE AS modified
  FROM evidence_sources e JOIN documents d USING (doc_id)),
h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS a, regexp_replace(lower(regexp_extract(final_url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS b,
  regexp_extract(final_url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM s)
SELECT record_id, CASE WHEN path IN ('', '/') THEN 'home page' WHEN modified - seen > 2 THEN 'modified later' WHEN a <> b THEN 'host changed' WHEN seen IS NOT NULL AND modified IS NOT NULL THEN 'plausible' ELSE 'unverified' END AS status FROM h""",
}
