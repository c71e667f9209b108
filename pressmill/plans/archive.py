"""Queries over archive-shaped rows: timeline deliveries as observations, events as mentions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import labels as L
from pressmill.functions import urls as U
from pressmill.operators import archive as A
from pressmill.shared import shared_folder
from pressmill.sources import files
from pressmill.tables import table

SEED, CUTOFF = "pressmill-1", "20260101000000"


def _observations(spark, folder: str) -> DataFrame:
    """Timeline deliveries as observations: batch from the seen date, the page address as document."""
    rows = table(spark, folder, "timeline_data").select("record_id", "id", "url", "language", "gdelt_seendate", "publisher")
    stamp = F.regexp_replace("gdelt_seendate", "[TZ]", "")
    document = U.canonical(F.regexp_replace("url", r"\?.*$", ""))
    return rows.select("record_id", "id", F.lower("language").alias("language"), A.batch_label(stamp).alias("batch"), document.alias("document_id"), U.host("url").alias("domain"), F.regexp_extract("url", r"^\w+://[^/]+/([a-z]+)/", 1).alias("topic"))


def archive_project(spark, folder: str) -> DataFrame:
    """Line items written as tab-separated lines, read back by position, wrong shapes counted apart."""
    items = table(spark, folder, "lineitem")
    # returned items lack their last field
    fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")]
    line = F.concat_ws("\t", *fields, F.when(F.col("l_returnflag") != "R", F.lit("")))
    parts = items.select(F.split(line, "\t", -1).alias("f"))
    shaped = parts.select(F.size("f").alias("n_fields"), F.get("f", F.lit(2)).alias("flag"), F.when(F.size("f") == 6, F.get("f", F.lit(4)).cast("bigint")).alias("supplier"))
    return shaped.groupBy("n_fields", "flag").agg(F.count("*").alias("n_lines"), F.count("supplier").alias("n_kept"), F.sum("supplier").alias("sum_supplier"))


def archive_files(spark, folder: str) -> DataFrame:
    """Documents written to files of tab-separated lines, one a topic, some lines broken, scanned back: per file, lines by status and field count."""
    rows = table(spark, folder, "documents").select(F.coalesce("topic", F.lit("none")).alias("file"), "doc_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\t\r\n]", " ").alias("url"))
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("url"), F.when(F.col("doc_id") % 10 == 3, "one\ttoo many").otherwise("last"))
    path = f"{shared_folder(spark)}/archive-files-{uuid.uuid4().hex}"
    rows.select("file", line.alias("value")).write.partitionBy("file").text(path)
    scanned = files.tsv_lines(spark, f"{path}/*/*.txt", 3)
    name = F.regexp_extract("file", r"file=([^/]+)/", 1)
    return scanned.groupBy(name.alias("file"), "status", F.size("fields").alias("n_fields")).agg(F.count("*").alias("n_lines"), F.sum(F.when(F.col("status") == "ok", F.get("fields", F.lit(0)).cast("bigint"))).alias("sum_id"))


def archive_asof_dedup(spark, folder: str) -> DataFrame:
    """Documents as known at the cutoff, by batch and document."""
    return A.deduplicate_as_of(_observations(spark, folder).where("document_id is not null"), ["document_id"], CUTOFF).orderBy("batch", "document_id")


def archive_language_share(spark, folder: str) -> DataFrame:
    """Share of energy pages among documents labelled english, german or russian first seen on each day of 2025-07-01 to 2026-06-30; ``archive_language_share_all`` has every language and day."""
    rows = _observations(spark, folder).where("document_id is not null")
    first = A.deduplicate_as_of(rows, ["document_id"]).select("document_id", "language", F.substring("batch", 1, 8).alias("bin"), F.get(F.split("document_id", "/"), F.lit(1)).alias("topic"))
    days = F.sequence(F.lit("2025-07-01").cast("date"), F.lit("2026-06-30").cast("date"))
    names = spark.createDataFrame([("english",), ("german",), ("russian",)], "language string")
    expected = names.withColumn("day", F.explode(days)).select("language", F.date_format("day", "yyyyMMdd").alias("bin"))
    return A.observed_share(first, expected, "energy").withColumn("share", F.round("share", 6))


def archive_language_share_all(spark, folder: str) -> DataFrame:
    """Share of energy pages among each language's documents first seen on each day, for every usable label's language and every day from the first batch to the last."""
    named = L.label_language(F.col("language"))
    # names and codes of one language are one; a label outside the six stays as it is
    language = F.when(named == "other", F.trim("language")).otherwise(named)
    rows = _observations(spark, folder).withColumn("language", language)
    topic = F.nullif(F.get(F.split("document_id", "/"), F.lit(1)), F.lit(""))
    first = A.deduplicate_as_of(rows.where("document_id is not null"), ["document_id"]).select("language", F.substring("batch", 1, 8).alias("bin"), topic.alias("topic"))
    day = F.try_to_date(F.substring("batch", 1, 8), "yyyyMMdd")
    days = rows.agg(F.min(day).alias("low"), F.max(day).alias("high")).where("low is not null").select(F.explode(F.sequence("low", "high")).alias("day"))
    expected = rows.where("language is not null").select("language").distinct().crossJoin(days).select("language", F.date_format("day", "yyyyMMdd").alias("bin"))
    return A.observed_share(first, expected, "energy").withColumn("share", F.round("share", 6))


def archive_collisions(spark, folder: str) -> DataFrame:
    """Digests that name more than one document."""
    return A.collisions(table(spark, folder, "documents").select(F.md5("text").alias("digest"), "doc_id"), "digest", "doc_id")


def archive_repeats(spark, folder: str) -> DataFrame:
    """Per day: rows, distinct documents, repeats within a batch; documents seen in several batches or languages."""
    rows = _observations(spark, folder).where("document_id is not null and batch is not null")
    by_batch = rows.groupBy("document_id", "batch").agg(F.count("*").alias("n"), F.min(F.coalesce("language", F.lit("?"))).alias("low"), F.max(F.coalesce("language", F.lit("?"))).alias("high"), F.min("batch").alias("b"))
    documents = by_batch.groupBy("document_id").agg(F.min("b").alias("first"), F.sum("n").alias("n_rows"), F.count("*").alias("n_batches"), F.sum(F.col("n") - 1).alias("n_within"), (F.min("low") != F.max("high")).alias("conflict"))
    return documents.groupBy(F.substring("first", 1, 8).alias("day")).agg(
        F.count("*").alias("n_documents"), F.sum("n_rows").alias("n_rows"), F.sum("n_within").alias("n_within_batch"), F.count_if(F.col("n_batches") > 1).alias("n_across_batches"), F.count_if("conflict").alias("n_conflicts"),
    )


def archive_language_by_bin(spark, folder: str) -> DataFrame:
    """Batches with English rows, with others, with both."""
    rows = _observations(spark, folder).where("batch is not null and language is not null")
    english = F.col("language") == "english"
    return rows.groupBy("batch").agg(F.bool_or(english).alias("has_english"), F.bool_or(~english).alias("has_other"), F.count("*").alias("n_rows")).withColumn("has_both", F.col("has_english") & F.col("has_other"))


def archive_distinct_docs(spark, folder: str) -> DataFrame:
    """Distinct documents per language, with their days."""
    rows = _observations(spark, folder).where("document_id is not null").withColumn("day", F.substring("batch", 1, 8))
    return rows.groupBy("language").agg(F.count("*").alias("n_rows"), F.countDistinct("document_id").alias("n_documents"), F.countDistinct("day").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def archive_domains(spark, folder: str) -> DataFrame:
    """Rows, documents and languages of every publishing host."""
    rows = _observations(spark, folder).where("domain <> ''")
    return rows.groupBy("domain").agg(F.count("*").alias("n_rows"), F.countDistinct("document_id").alias("n_documents"), F.countDistinct("language").alias("n_languages"))


def mention_links(spark, folder: str) -> DataFrame:
    """Purchases linked to views of the same user: any, as of the purchase's batch, in its batch."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", A.batch_label(F.date_format("ts", "yyyyMMddHHmmss")).alias("batch"))
    linked = A.asof_links(events.where("event_type = 'purchase'").select("event_id", "user_id", "batch"), events.where("event_type = 'view'").select("user_id", "batch"), "user_id", "batch")
    return linked.select("event_id", "n_any", "n_as_of", "n_same", (F.col("n_as_of") > 0).alias("linked_as_of"))


def mention_rows(spark, folder: str) -> DataFrame:
    """Of each user and batch with a purchase, the batches and ids of all the user's views as of then."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", A.batch_label(F.date_format("ts", "yyyyMMddHHmmss")).alias("batch"))
    rows = A.asof_rows(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "batch", "event_id")
    return rows.select("user_id", "batch", F.array_join(F.transform("as_of_rows", lambda r: F.concat_ws(":", r["bin"], r["value"].cast("string"))), ",").alias("as_of_rows"))


def mention_event_lastwins(spark, folder: str) -> DataFrame:
    """Deliveries against the last delivery of their event: whether page and day still agree; null where unknown."""
    rows = table(spark, folder, "timeline_data").select("record_id", "id", "url", "display_date", "gdelt_seendate")
    last = A.last_row(rows.where("id is not null").select("id", "record_id", F.col("url").alias("last_url"), F.col("display_date").alias("last_day")), "id", "record_id").withColumnRenamed("record_id", "last_record")
    seen_day = F.substring("gdelt_seendate", 1, 8)
    return rows.join(last, "id", "left").select("record_id", "last_record", (F.col("url") == F.col("last_url")).alias("same_url"), (F.date_format("display_date", "yyyyMMdd") == seen_day).alias("seen_on_day"), (F.col("display_date") == F.col("last_day")).alias("same_day"))


def file_checksum_agreement(spark, folder: str) -> DataFrame:
    """Page texts of sources against the newest fetch of the same address."""
    pages = table(spark, folder, "documents").select("doc_id", "crawled_at", U.canonical(F.regexp_replace("url", r"\?.*$", "")).alias("page"), F.col("n_chars").alias("size"), F.md5("text").alias("digest"))
    newest = pages.where("page is not null and crawled_at is not null").groupBy("page").agg(F.max(F.struct("crawled_at", "doc_id", "size", "digest")).alias("n"))
    manifest = newest.select("page", F.col("n.size").alias("listed_size"), F.col("n.digest").alias("listed_digest"))
    sources = table(spark, folder, "evidence_sources").select("record_id", "doc_id", U.canonical(F.regexp_replace("url", r"\?.*$", "")).alias("source_page"))
    files = sources.join(pages.select("doc_id", "size", "digest"), "doc_id", "left").withColumnRenamed("source_page", "page")
    return A.checksum_agreement(files, manifest, "page").select("record_id", F.col("listed_size").isNotNull().alias("listed"), "agrees")


def manifest_scan(spark, folder: str) -> DataFrame:
    """Manifest lines written from documents and read back: size, digest, batch label of the name, its validity."""
    pages = table(spark, folder, "documents").select("doc_id", "n_chars", "url", "crawled_at")
    name = F.concat(F.lit("https://archive.example/v2/"), F.date_format("crawled_at", "yyyyMMddHHmmss"), F.lit(".GKG.csv.zip"))
    lines = pages.where("crawled_at is not null").select(F.concat_ws("  ", F.lit(" "), F.col("n_chars").cast("string"), F.md5("url"), name).alias("line"))
    parts = lines.select(F.split(F.trim("line"), r"\s+").alias("p")).where((F.size("p") == 3) & F.get("p", F.lit(0)).rlike(r"^\d+$"))
    label = F.regexp_extract(F.get("p", F.lit(2)), r"(?i)/(\d{14})\.(?:translation\.)?(gkg|mentions|export)\.csv(?:\.zip)?$", 1)
    rows = parts.select(F.get("p", F.lit(0)).cast("bigint").alias("size"), label.alias("batch"))
    return rows.groupBy("batch").agg(F.count("*").alias("n_lines"), F.sum("size").alias("bytes")).withColumn("valid", A.valid_stamp(F.col("batch")))


def size_estimates(spark, folder: str) -> DataFrame:
    """Sizes per source: characters, bytes, bytes per character, and an extrapolation to 28 days."""
    rows = table(spark, folder, "documents").select("source", "n_chars", F.octet_length("text").alias("bytes"), F.date_format("crawled_at", "yyyyMMdd").alias("day"))
    sums = rows.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_chars").alias("chars"), F.sum("bytes").cast("bigint").alias("bytes"), F.countDistinct("day").alias("n_days"))
    return sums.select("source", "n_texts", "chars", "bytes", F.round(F.try_divide(F.col("bytes").cast("double"), "chars"), 6).alias("bytes_per_char"), F.round(F.try_divide(F.col("bytes").cast("double"), "n_days") * 28, 3).alias("estimate_28_days"))


def _streams(spark, folder: str) -> list[DataFrame]:
    page = lambda: U.canonical(F.regexp_replace("url", r"\?.*$", ""))
    return [table(spark, folder, name).select("record_id", page().alias("page"), F.lit(name).alias("stream")) for name in ("synthetic_investigation", "evidence_sources", "timeline_data")]


def union_priority_dedup(spark, folder: str) -> DataFrame:
    """One row per page of three streams: imported articles first, then candidate pages, then timeline events."""
    return A.first_by_priority(_streams(spark, folder), "page")


def stream_overlap(spark, folder: str) -> DataFrame:
    """Pages by the streams they occur in."""
    out = None
    for rows in _streams(spark, folder):
        out = rows if out is None else out.unionAll(rows)
    kinds = out.where("page is not null").groupBy("page").agg(F.concat_ws("+", F.array_sort(F.collect_set("stream"))).alias("streams"))  # three names at most
    return kinds.groupBy("streams").agg(F.count("*").alias("n_pages"))


def group_stats(spark, folder: str) -> DataFrame:
    """How many candidate pages were kept, over all and by topic, origin, host and label."""
    rows = table(spark, folder, "evidence_sources").select(F.col("doc_id").isNotNull().alias("success"), "topic", "origin", U.host_key("url").alias("host"), F.col("language").alias("label_inferred"))
    return A.group_stats(rows, ["topic", "origin", "host", "label_inferred"]).withColumn("failed_fraction", F.round("failed_fraction", 6))


def sample_hash_topk(spark, folder: str) -> DataFrame:
    """Twelve candidate pages of every topic in seeded digest order."""
    rows = table(spark, folder, "evidence_sources").where("url is not null and topic is not null").select("record_id", "topic", "url")
    return A.hash_sample(rows, "topic", "url", SEED, 12).select("topic", "place", "record_id", "digest")


def weighted_vote(spark, folder: str) -> DataFrame:
    """Each publisher's label by the length of the titles under it."""
    rows = table(spark, folder, "timeline_data").where("publisher is not null and language is not null and title is not null").select("publisher", F.lower("language").alias("language"), F.char_length("title").alias("w"))
    return A.weighted_vote(rows, "publisher", "language", "w").withColumn("agreement", F.round("agreement", 6))


QUERIES = {
    f.__name__: f
    for f in (
        archive_project, archive_files, archive_asof_dedup, archive_language_share, archive_language_share_all, archive_collisions, archive_repeats, archive_language_by_bin, archive_distinct_docs, archive_domains,
        mention_links, mention_rows, mention_event_lastwins, file_checksum_agreement, manifest_scan, size_estimates, union_priority_dedup, stream_overlap, group_stats, sample_hash_topk, weighted_vote,
    )
}


def _host(url: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"


def _page(url: str) -> str:
    bare = rf"regexp_replace({url}, '\?.*$', '')"
    return rf"CASE WHEN {_host(bare)} <> '' THEN {_host(bare)} || regexp_replace(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END"


_OBS = rf"""obs AS (SELECT record_id, id, lower(language) AS language, substr(s, 1, 10) || lpad(((substr(s, 11, 2)::INT // 15) * 15)::VARCHAR, 2, '0') || '00' AS batch,
  {_page('url')} AS document_id, {_host('url')} AS domain FROM (SELECT *, regexp_replace(gdelt_seendate, '[TZ]', '', 'g') AS s FROM timeline_data))"""
_DEDUP = """firsts AS (SELECT document_id, min(batch) AS batch FROM obs WHERE document_id IS NOT NULL AND batch IS NOT NULL {cut} GROUP BY 1),
dedup AS (SELECT document_id, batch, min(record_id) AS record_id, CASE WHEN count(DISTINCT language) = 1 AND count(*) = count(language) THEN min(language) END AS language,
  CASE WHEN count(DISTINCT language) + (count(*) > count(language))::INT > 1 THEN 'ambiguous_first_batch' ELSE 'single' END AS language_status FROM obs JOIN firsts USING (document_id, batch) GROUP BY 1, 2)"""
_NAMES = ", ".join(f"('{name}', '{language}')" for language, ns in L.LABELS.items() for name in ns.split())
_NONE = ", ".join(f"'{x}'" for x in L.NO_LANGUAGE)
SQL = {
    "archive_project": """SELECT CASE WHEN l_returnflag = 'R' THEN 5 ELSE 6 END::INT AS n_fields, l_returnflag AS flag, count(*) AS n_lines, count(*) FILTER (l_returnflag <> 'R') AS n_kept,
sum(CASE WHEN l_returnflag <> 'R' THEN l_suppkey END)::BIGINT AS sum_supplier FROM lineitem GROUP BY 1, 2""",
    "archive_files": """SELECT coalesce(topic, 'none') AS file, CASE WHEN doc_id % 10 = 3 THEN 'wrong_shape' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 = 3 THEN 4 ELSE 3 END::INT AS n_fields, count(*) AS n_lines,
sum(CASE WHEN doc_id % 10 <> 3 THEN doc_id END)::BIGINT AS sum_id FROM documents GROUP BY 1, 2, 3""",
    "archive_asof_dedup": f"WITH {_OBS}, {_DEDUP.format(cut=f'AND batch <= {CUTOFF!r}')} SELECT * FROM dedup",
    "archive_language_share": f"""WITH {_OBS}, {_DEDUP.format(cut='')}, d AS (SELECT language, substr(batch, 1, 8) AS bin, split_part(document_id, '/', 2) AS topic FROM dedup),
e AS (SELECT language, strftime(day, '%Y%m%d') AS bin FROM (VALUES ('english'), ('german'), ('russian')) l(language), generate_series(TIMESTAMP '2025-07-01', TIMESTAMP '2026-06-30', INTERVAL 1 DAY) g(day)),
b AS (SELECT bin, count(*) AS n_bin FROM d GROUP BY 1), u AS (SELECT language, bin, count(*) AS n_all, count(*) FILTER (topic = 'energy') AS n_topic FROM d WHERE language IS NOT NULL GROUP BY 1, 2)
SELECT e.language, e.bin, CASE WHEN n_bin IS NULL THEN 'missing_bin' WHEN n_all IS NULL THEN 'no_usable_language_exposure' ELSE 'observed' END AS status, n_topic, n_all, round(n_topic::DOUBLE / nullif(n_all, 0), 6) AS share
FROM e LEFT JOIN b USING (bin) LEFT JOIN u USING (language, bin)""",
    "archive_language_share_all": rf"""WITH names(label, name) AS (VALUES {_NAMES}), {_OBS.replace('obs AS', 'raw AS')},
obs AS (SELECT r.* EXCLUDE (language), CASE WHEN trim(language, ' ') IN ({_NONE}) THEN NULL WHEN coalesce(a.name, b.name) IS NOT NULL THEN coalesce(a.name, b.name) WHEN regexp_matches(trim(language, ' '), '^\p{{L}}{{2,}}') THEN trim(language, ' ') END AS language
  FROM raw r LEFT JOIN names a ON a.label = trim(language, ' ') LEFT JOIN names b ON b.label = regexp_extract(trim(language, ' '), '^([\p{{L}}]{{2,3}})[-_]', 1)),
{_DEDUP.format(cut='')}, d AS (SELECT language, substr(batch, 1, 8) AS bin, nullif(split_part(document_id, '/', 2), '') AS topic FROM dedup),
days AS (SELECT min(strptime(substr(batch, 1, 8), '%Y%m%d')) AS low, max(strptime(substr(batch, 1, 8), '%Y%m%d')) AS high FROM obs),
e AS (SELECT language, strftime(day, '%Y%m%d') AS bin FROM (SELECT DISTINCT language FROM obs WHERE language IS NOT NULL), (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY)) AS day FROM days)),
b AS (SELECT bin, count(*) AS n_bin FROM d GROUP BY 1), u AS (SELECT language, bin, count(*) AS n_all, count(*) FILTER (topic = 'energy') AS n_topic, count(*) FILTER (topic IS NULL) AS n_unknown FROM d WHERE language IS NOT NULL GROUP BY 1, 2)
SELECT e.language, e.bin, CASE WHEN n_bin IS NULL THEN 'missing_bin' WHEN n_all IS NULL THEN 'no_usable_language_exposure' WHEN n_unknown > 0 THEN 'topic_membership_unverified' ELSE 'observed' END AS status,
CASE WHEN n_unknown = 0 THEN n_topic END AS n_topic, n_all, CASE WHEN n_unknown = 0 THEN round(n_topic::DOUBLE / nullif(n_all, 0), 6) END AS share FROM e LEFT JOIN b USING (bin) LEFT JOIN u USING (language, bin)""",
    "archive_collisions": """SELECT md5(text) AS digest, count(*) AS n_documents, count(*) AS n_rows, min(doc_id) AS first_document, max(doc_id) AS last_document
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "archive_repeats": f"""WITH {_OBS}, o AS (SELECT *, coalesce(language, '?') AS lang FROM obs WHERE document_id IS NOT NULL AND batch IS NOT NULL),
d AS (SELECT document_id, min(batch) AS first, count(*) AS n_rows, count(DISTINCT batch) AS n_batches, count(*) - count(DISTINCT batch) AS n_within, count(DISTINCT lang) > 1 AS conflict FROM o GROUP BY 1)
SELECT substr(first, 1, 8) AS day, count(*) AS n_documents, sum(n_rows)::BIGINT AS n_rows, sum(n_within)::BIGINT AS n_within_batch, count(*) FILTER (n_batches > 1) AS n_across_batches, count(*) FILTER (conflict) AS n_conflicts FROM d GROUP BY 1""",
    "archive_language_by_bin": f"""WITH {_OBS} SELECT batch, bool_or(language = 'english') AS has_english, bool_or(language <> 'english') AS has_other, count(*) AS n_rows,
bool_or(language = 'english') AND bool_or(language <> 'english') AS has_both FROM obs WHERE batch IS NOT NULL AND language IS NOT NULL GROUP BY 1""",
    "archive_distinct_docs": f"""WITH {_OBS} SELECT language, count(*) AS n_rows, count(DISTINCT document_id) AS n_documents, count(DISTINCT substr(batch, 1, 8)) AS n_days, min(substr(batch, 1, 8)) AS first_day, max(substr(batch, 1, 8)) AS last_day
FROM obs WHERE document_id IS NOT NULL GROUP BY 1""",
    "archive_domains": f"WITH {_OBS} SELECT domain, count(*) AS n_rows, count(DISTINCT document_id) AS n_documents, count(DISTINCT language) AS n_languages FROM obs WHERE domain <> '' GROUP BY 1",
    "mention_links": """WITH e AS (SELECT event_id, user_id, event_type, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y%m%d%H%M%S') AS batch FROM events),
v AS (SELECT user_id, batch, count(*) AS n FROM e WHERE event_type = 'view' GROUP BY 1, 2)
SELECT m.event_id, coalesce(sum(v.n), 0)::BIGINT AS n_any, coalesce(sum(v.n) FILTER (v.batch <= m.batch), 0)::BIGINT AS n_as_of, coalesce(sum(v.n) FILTER (v.batch = m.batch), 0)::BIGINT AS n_same,
coalesce(sum(v.n) FILTER (v.batch <= m.batch), 0) > 0 AS linked_as_of FROM e m LEFT JOIN v USING (user_id) WHERE m.event_type = 'purchase' GROUP BY 1""",
    "mention_rows": """WITH e AS (SELECT event_id, user_id, event_type, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y%m%d%H%M%S') AS batch FROM events),
p AS (SELECT DISTINCT user_id, batch FROM e WHERE event_type = 'purchase')
SELECT p.user_id, p.batch, coalesce(string_agg(v.batch || ':' || v.event_id, ',' ORDER BY v.batch, v.event_id), '') AS as_of_rows FROM p LEFT JOIN e v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.batch <= p.batch GROUP BY 1, 2""",
    "mention_event_lastwins": """WITH l AS (SELECT id, max(record_id) AS last_record FROM timeline_data WHERE id IS NOT NULL GROUP BY 1),
x AS (SELECT l.id, last_record, url AS last_url, display_date AS last_day FROM l JOIN timeline_data t ON t.record_id = last_record)
SELECT record_id, last_record, url = last_url AS same_url, strftime(display_date, '%Y%m%d') = substr(gdelt_seendate, 1, 8) AS seen_on_day, display_date = last_day AS same_day FROM timeline_data t LEFT JOIN x ON x.id = t.id""",
    "file_checksum_agreement": f"""WITH p AS (SELECT doc_id, crawled_at, {_page('url')} AS page, n_chars AS size, md5(text) AS digest FROM documents),
m AS (SELECT * FROM p WHERE page IS NOT NULL AND crawled_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY crawled_at DESC, doc_id DESC) = 1)
SELECT s.record_id, m.page IS NOT NULL AS listed, p.size = m.size AND p.digest = m.digest AS agrees FROM evidence_sources s LEFT JOIN p ON p.doc_id = s.doc_id LEFT JOIN m ON m.page = {_page('s.url')}""",
    "manifest_scan": """SELECT strftime(crawled_at, '%Y%m%d%H%M%S') AS batch, count(*) AS n_lines, sum(n_chars)::BIGINT AS bytes, strftime(crawled_at, '%S') = '00' AND strftime(crawled_at, '%M')::INT % 15 = 0 AS valid
FROM documents WHERE crawled_at IS NOT NULL GROUP BY 1, 4""",
    "size_estimates": """SELECT source, count(*) AS n_texts, sum(n_chars)::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text))::DOUBLE / nullif(sum(n_chars), 0), 6) AS bytes_per_char,
round(sum(strlen(text))::DOUBLE / nullif(count(DISTINCT strftime(crawled_at, '%Y%m%d')), 0) * 28, 3) AS estimate_28_days FROM documents GROUP BY 1""",
    "union_priority_dedup": f"""WITH a AS (SELECT record_id, {_page('url')} AS page, 'synthetic_investigation' AS stream, 1 AS priority FROM synthetic_investigation UNION ALL
SELECT record_id, {_page('url')}, 'evidence_sources', 2 FROM evidence_sources UNION ALL SELECT record_id, {_page('url')}, 'timeline_data', 3 FROM timeline_data)
SELECT page, priority, record_id, stream FROM a WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY priority, record_id) = 1""",
    "stream_overlap": f"""WITH a AS (SELECT {_page('url')} AS page, 'synthetic_investigation' AS stream FROM synthetic_investigation UNION ALL SELECT {_page('url')}, 'evidence_sources' FROM evidence_sources UNION ALL
SELECT {_page('url')}, 'timeline_data' FROM timeline_data), k AS (SELECT page, string_agg(DISTINCT stream, '+' ORDER BY stream) AS streams FROM a WHERE page IS NOT NULL GROUP BY 1) SELECT streams, count(*) AS n_pages FROM k GROUP BY 1""",
    "group_stats": f"""WITH r AS (SELECT doc_id IS NOT NULL AS success, topic, origin, regexp_replace({_host('url')}, '^www\\.', '') AS host, language FROM evidence_sources),
g AS (SELECT 'all' AS scope, 'all' AS value, success FROM r UNION ALL SELECT 'topic', topic, success FROM r UNION ALL SELECT 'origin', origin, success FROM r UNION ALL SELECT 'host', host, success FROM r UNION ALL SELECT 'label_inferred', language, success FROM r)
SELECT scope, value, count(*) AS n, count(*) FILTER (success) AS n_success, CASE WHEN scope <> 'label_inferred' THEN count(*) FILTER (NOT success) END AS n_failed,
CASE WHEN scope <> 'label_inferred' THEN round((count(*) FILTER (NOT success))::DOUBLE / count(*), 6) END AS failed_fraction FROM g GROUP BY 1, 2""",
    "sample_hash_topk": f"""SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY sha256('{SEED}|' || url), record_id)::INT AS place, record_id, sha256('{SEED}|' || url) AS digest
FROM evidence_sources WHERE url IS NOT NULL AND topic IS NOT NULL QUALIFY place <= 12""",
    "weighted_vote": """WITH v AS (SELECT publisher, lower(language) AS label, sum(length(title)) AS w FROM timeline_data WHERE publisher IS NOT NULL AND language IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2)
SELECT publisher, label, round(w::DOUBLE / sum(w) OVER (PARTITION BY publisher), 6) AS agreement FROM v QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY w DESC, label) = 1""",
}
