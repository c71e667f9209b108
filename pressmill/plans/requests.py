"""Queries over request-shaped rows made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import urls as U
from pressmill.operators import requests as R
from pressmill.plans.archive import _host, _page
from pressmill.tables import table


def header_lookup(spark, folder: str) -> DataFrame:
    """Last-Modified read from a header map whose names come in any case."""
    rows = table(spark, folder, "documents")
    name = F.when(F.col("topic") == "rail", "LAST-MODIFIED").otherwise("last-Modified")
    headers = F.create_map(name, F.date_format("crawled_at", "yyyyMMdd"), F.lit("Content-Type"), F.lit("text/html"))
    return rows.select("doc_id", R.header_value(headers, "Last-Modified").alias("modified"), R.header_value(headers, "x-none").alias("absent"))


def retry_eligible(spark, folder: str) -> DataFrame:
    """Candidate pages whose fetch may be tried again, by origin."""
    rows = table(spark, folder, "evidence_sources")
    status = F.when(F.col("doc_id").isNotNull(), 200).when(F.col("request_file").isNull(), F.lit(None).cast("int")).when(F.col("topic") == "rail", 404).otherwise(503)
    attempts = F.when(F.col("origin") == "manual_entry", 2).otherwise(1)
    marked = rows.select("origin", R.may_retry(status, attempts, F.when(F.col("doc_id").isNotNull(), 1)).alias("again"))
    return marked.groupBy("origin").agg(F.count("*").alias("n_pages"), F.count_if("again").alias("n_retry"))


def newest_answers(spark, folder: str) -> DataFrame:
    """Each candidate id's last row."""
    rows = table(spark, folder, "evidence_sources").select("id", "record_id", "url", "doc_id")
    return R.newest_per_key(rows, "id", "record_id")


def kept_pages(spark, folder: str) -> DataFrame:
    """Candidate rows whose page address is among the kept documents."""
    page = lambda: U.canonical(F.regexp_replace("url", r"\?.*$", ""))
    kept = table(spark, folder, "documents").select(page().alias("page")).where("page is not null").distinct()
    return table(spark, folder, "evidence_sources").select("record_id", page().alias("page")).join(kept, "page", "left_semi").select("record_id")


def any_key_match(spark, folder: str) -> DataFrame:
    """How many documents each candidate page meets by its plain or its mobile address."""
    page = U.canonical(F.regexp_replace("url", r"\?.*$", ""))
    sources = table(spark, folder, "evidence_sources").select("record_id", page.alias("page"))
    documents = table(spark, folder, "documents").select("doc_id", page.alias("page"))
    mobile = F.concat(F.lit("m."), F.col("page"))
    pairs = R.match_any_key(sources, "record_id", [F.col("page"), mobile], documents, "doc_id", [F.col("page"), mobile])
    return pairs.groupBy(F.col("a").alias("record_id")).agg(F.count("*").alias("n_documents"), F.min("b").alias("first_document"))


def review_packets(spark, folder: str) -> DataFrame:
    """Digest of every document's review packet."""
    packets = R.review_packets(table(spark, folder, "documents"), "doc_id", "text")
    return packets.select("doc_id", F.md5("packet").alias("digest"), "cut")


QUERIES = {f.__name__: f for f in (header_lookup, retry_eligible, newest_answers, kept_pages, any_key_match, review_packets)}
SQL = {
    "header_lookup": "SELECT doc_id, strftime(crawled_at, '%Y%m%d') AS modified, NULL AS absent FROM documents",
    "retry_eligible": """WITH s AS (SELECT origin, doc_id, CASE WHEN doc_id IS NOT NULL THEN 200 WHEN request_file IS NULL THEN NULL WHEN topic = 'rail' THEN 404 ELSE 503 END AS status, CASE WHEN origin = 'manual_entry' THEN 2 ELSE 1 END AS attempts FROM evidence_sources)
SELECT origin, count(*) AS n_pages, count(*) FILTER ((status IS NULL OR status >= 500 OR status = 429) AND attempts < 2 AND doc_id IS NULL) AS n_retry FROM s GROUP BY 1""",
    "newest_answers": "SELECT id, record_id, url, doc_id FROM evidence_sources WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_id DESC) = 1",
    "kept_pages": f"SELECT record_id FROM evidence_sources s WHERE {_page('s.url')} IN (SELECT {_page('url')} FROM documents WHERE {_host('url')} <> '')",
    "any_key_match": f"""WITH d AS (SELECT doc_id, {_page('url')} AS page FROM documents) SELECT s.record_id, count(DISTINCT d.doc_id) AS n_documents, min(d.doc_id) AS first_document
FROM evidence_sources s JOIN d ON d.page = {_page('s.url')} GROUP BY 1""",
    "review_packets": "SELECT doc_id, md5(substr(text, 1, 7000)) AS digest, length(text) > 7000 AS cut FROM documents",
}
