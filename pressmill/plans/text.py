"""Queries over addresses, texts, labels and claimed times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import text as T
from pressmill.functions import urls as U
from pressmill.plans.archive import _host, _page
from pressmill.tables import table

WORDS, INSIDE = ["terminal", "strike", "huelga", "grève", "streik"], ["забастовк", "罢工", "运河"]


def url_parts(spark, folder: str) -> DataFrame:
    """Parts of every timeline address, whether it is safe to open, its host key and web domain."""
    rows = table(spark, folder, "timeline_data").where("url is not null")
    url = F.col("url")
    return rows.select("record_id", U.scheme(url).alias("scheme"), U.host(url).alias("host"), U.host_key(url).alias("host_key"), U.path(url).alias("path"), U.query(url).alias("query"), U.safe(url).isNotNull().alias("safe"),
                       U.web_domain(F.when(F.col("role").isNotNull(), F.lit("1")), url).alias("web_domain"))


def url_identity_match(spark, folder: str) -> DataFrame:
    """Candidate pages that share an address, but for query, fragment and trailing slash, with kept documents."""
    bare = lambda c: U.canonical(F.regexp_replace(U.identity(F.col(c)), r"\?.*$", ""))
    kept = table(spark, folder, "documents").select(bare("url").alias("page")).where("page is not null").groupBy("page").agg(F.count("*").alias("n_documents"))
    sources = table(spark, folder, "evidence_sources").select("record_id", "doc_id", bare("url").alias("page"))
    return sources.join(kept, "page", "left").select("record_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), (F.col("doc_id").isNotNull() == F.col("n_documents").isNotNull()).alias("consistent"))


def html_lang_title(spark, folder: str) -> DataFrame:
    """Language and title read back from a page written around each document."""
    rows = table(spark, folder, "documents")
    html = F.concat(F.lit('<!doctype html><HTML data-x="1" lang="'), F.coalesce("lang", F.lit("und")), F.lit('"><head><title>\n'), F.coalesce("topic", F.lit("")), F.lit(" &amp;  more</title></head></html>"))
    page = rows.select("doc_id", html.alias("html"))
    return page.select("doc_id", T.html_language(F.col("html")).alias("html_language"), T.html_title(F.col("html")).alias("title"))


def language_metadata_rule(spark, folder: str) -> DataFrame:
    """Source language of a translation field written from each source's label; the engine's own code never counts."""
    rows = table(spark, folder, "evidence_sources").select("record_id", "topic", F.lower("language").alias("l"))
    info = F.when(F.col("l").isNotNull(), F.concat(F.lit("srclc:"), "l", F.when(F.col("topic") == "rail", F.lit(";srclc:rus")).otherwise(""), F.lit(";eng:GT 1.0")))
    language, status = T.original_language(F.col("info"))
    return rows.select("record_id", info.alias("info")).select("record_id", language.alias("language"), status.alias("status"), T.info_map(F.col("info"))["eng"].alias("engine"))


def quality_gates(spark, folder: str) -> DataFrame:
    """The gate of those on title and text alone that each document stops at, with the measures behind it."""
    rows = table(spark, folder, "documents")
    place = F.pmod("doc_id", F.lit(60))
    title = F.when(place == 0, "Forbidden harbour").when(place == 1, "PÁGINA no encontrada").when(place == 2, "Seite nicht gefunden").when(place == 3, "Ship not found").otherwise(F.col("topic"))
    status = T.quality_status(F.col("url").isNotNull(), title, F.col("text"))
    return rows.select("doc_id", status.alias("status"), T.alphabetic(F.col("text")).alias("letters"), T.sentence_marks(F.col("text")).alias("marks"), T.paragraphs(F.col("text")).alias("paragraphs"))


def hint_terms(spark, folder: str) -> DataFrame:
    """Titles that name a strike, a terminal or a canal, with the terms."""
    rows = table(spark, folder, "timeline_data").select("record_id", F.array_join(T.terms_in(F.col("title"), WORDS, INSIDE), ",").alias("terms"))
    return rows.where("terms <> ''")


def support_terms(spark, folder: str) -> DataFrame:
    """Documents that hold all of a claim's terms."""
    rows = table(spark, folder, "documents")
    return rows.where("text is not null").select("doc_id", T.has_all(F.col("text"), ["terminal", "port"]).alias("supports_port"), T.has_all(F.col("text"), ["Strike", "workers", "dock"]).alias("supports_strike"))


def excerpt_truncate(spark, folder: str) -> DataFrame:
    """First 900 characters of every document without a broken last word."""
    cut, truncated = T.excerpt(F.col("text"))
    rows = table(spark, folder, "documents").select("doc_id", cut.alias("excerpt"), truncated.alias("truncated"))
    return rows.select("doc_id", F.char_length("excerpt").alias("n_chars"), F.md5("excerpt").alias("digest"), "truncated")


def line_range_excerpt(spark, folder: str) -> DataFrame:
    """Lines two to four and line six of every document."""
    rows, ranges = table(spark, folder, "documents"), [(2, 4), (6, 6)]
    return rows.select("doc_id", T.line_ranges(F.col("text"), ranges).alias("excerpt"), F.lit(T.ranges_label(ranges)).alias("label"))


def text_guards(spark, folder: str) -> DataFrame:
    """Titles and publishers made safe for sheets and tables, ids checked, credentials named."""
    rows = table(spark, folder, "timeline_data")
    written = F.concat(F.when(F.col("language") == "german", F.lit("=")).otherwise(""), F.coalesce("title", F.lit("")))
    return rows.select("record_id", T.sheet_guard(written).alias("sheet_cell"), T.table_escape(F.col("title")).alias("table_cell"), T.is_slug(F.col("id")).alias("slug"), T.is_slug(F.col("publisher")).alias("publisher_slug"))


def secret_scan(spark, folder: str) -> DataFrame:
    """Documents, some with a credential written after their text, as files to publish: by kinds of credentials and by path issues."""
    rows = table(spark, folder, "documents").select("doc_id", "topic", "n_chars", F.concat_ws(" ", "text", F.get(F.array(*map(F.lit, _PLANTED)), F.pmod("doc_id", F.lit(50)).cast("int"))).alias("text"))
    name = F.concat(F.get(F.array(*map(F.lit, _PLACES)), F.pmod("doc_id", F.lit(7)).cast("int")), F.col("doc_id").cast("string"), F.when(F.col("topic") == "rail", ".log").otherwise(".txt"))
    kinds = F.array_join(T.secret_kinds(F.col("text")), ",")
    return rows.groupBy(kinds.alias("kinds"), T.path_issue(name, F.col("n_chars") * 40).alias("path_issue")).agg(F.count("*").alias("n_documents"))


# Written so that no scan of this file takes them for credentials.
_PLANTED = ("-----BEGIN " + "EC PRIVATE KEY-----", "github" + "_pat_" + "a1B2_" * 4, "gho" + "_" + "aB3" * 10, "AKIA" + "ABCD" * 4, "sk" + "-" + "x9" * 16, "xoxb" + "-" + "1a-" * 7, "gho" + "_" + "aB3" * 9, "name@mail.example")
_PLACES = ("pages/", "cache/", "pages/backup/", "pages/.env", "historical/", "pages/historical/", "notes/")


def claimed_time_rules(spark, folder: str) -> DataFrame:
    """Claims as the import rules see them: a day under date precision, a time with a colon offset under datetime."""
    rows = table(spark, folder, "synthetic_investigation").where("claimed_timestamp is not null")
    value, precision = F.col("claimed_timestamp.value"), F.col("claimed_timestamp.precision")
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    problem = (
        F.when(~F.coalesce(precision.isin("date", "datetime"), F.lit(False)), "precision must be date or datetime").when((precision == "date") & ~F.coalesce(day, F.lit(False)), "date precision needs a day")
        .when((precision == "datetime") & T.strict_utc_second(value).isNull(), "datetime needs an explicit offset").otherwise("ok")
    )
    return rows.select("record_id", problem.alias("problem"), F.when(problem == "ok", T.strict_utc_second(value)).alias("utc_second"))


def copied_lines(spark, folder: str) -> DataFrame:
    """Lines of at least 60 characters that several documents share."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)).alias("line"))
    long = lines.where(F.char_length("line") >= 60).select("doc_id", F.md5("line").alias("digest"))
    return long.groupBy("digest").agg(F.countDistinct("doc_id").alias("n_documents"), F.min("doc_id").alias("first_doc")).where("n_documents > 1")


QUERIES = {
    f.__name__: f
    for f in (
        url_parts, url_identity_match, html_lang_title, language_metadata_rule, quality_gates, hint_terms, support_terms, excerpt_truncate, line_range_excerpt, text_guards, secret_scan,
        claimed_time_rules, copied_lines,
    )
}

_LINES = r"string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
_LETTERS = r"length(regexp_replace({}, '[^\p{{L}}]', '', 'g'))"
_BOUND = r"(^|[^\p{L}\p{N}_])"
_END = r"($|[^\p{L}\p{N}_])"
_TERMS = ", ".join([f"CASE WHEN regexp_matches(lower(title), '{_BOUND}{w}{_END}') THEN '{w}' END" for w in WORDS] + [f"CASE WHEN contains(lower(title), '{w}') THEN '{w}' END" for w in INSIDE])
SQL = {
    "url_parts": rf"""SELECT record_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, {_host('url')} AS host, regexp_replace({_host('url')}, '^www\.', '') AS host_key,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*\?([^#]*)', 1) AS query,
lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) IN ('http', 'https') AND {_host('url')} <> '' AND NOT contains(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '@') AND NOT regexp_matches(url, '\s') AS safe,
CASE WHEN role IS NOT NULL AND {_host('url')} <> '' THEN {_host('url')} END AS web_domain FROM timeline_data WHERE url IS NOT NULL""",
    "url_identity_match": f"""WITH k AS (SELECT {_page('url')} AS page, count(*) AS n FROM documents GROUP BY 1)
SELECT record_id, coalesce(n, 0) AS n_documents, (doc_id IS NOT NULL) = (n IS NOT NULL) AS consistent FROM evidence_sources s LEFT JOIN k ON k.page = {_page('s.url')}""",
    "html_lang_title": r"""WITH t AS (SELECT doc_id, lower(regexp_extract(coalesce(lang, 'und'), '^([A-Za-z]{2,8})', 1)) AS tag, coalesce(topic, '') AS topic FROM documents)
SELECT doc_id, CASE WHEN tag NOT IN ('', 'und', 'unk', 'zxx') THEN CASE tag WHEN 'eng' THEN 'en' WHEN 'spa' THEN 'es' WHEN 'deu' THEN 'de' WHEN 'ger' THEN 'de' WHEN 'fra' THEN 'fr' WHEN 'fre' THEN 'fr' WHEN 'rus' THEN 'ru'
WHEN 'zho' THEN 'zh' WHEN 'chi' THEN 'zh' ELSE tag END END AS html_language, trim(topic || ' & more') AS title FROM t""",
    "language_metadata_rule": r"""WITH s AS (SELECT record_id, lower(language) AS l, trim(lower(language)) AS code, coalesce(topic = 'rail', false) AS two FROM evidence_sources),
x AS (SELECT *, CASE WHEN l IS NULL THEN 'missing' WHEN two AND code <> 'rus' THEN 'conflicting' WHEN regexp_matches(code, '^[a-z]{3}$') AND code NOT IN ('und', 'unk', 'xxx', 'zxx') THEN 'explicit' ELSE 'unusable' END AS status FROM s)
SELECT record_id, CASE WHEN status = 'explicit' THEN code END AS language, status, CASE WHEN l IS NOT NULL THEN 'GT 1.0' END AS engine FROM x""",
    "quality_gates": rf"""WITH m AS (SELECT doc_id, url, CASE doc_id % 60 WHEN 0 THEN 'Forbidden harbour' WHEN 1 THEN 'PÁGINA no encontrada' WHEN 2 THEN 'Seite nicht gefunden' WHEN 3 THEN 'Ship not found' ELSE topic END AS title, text, {_LETTERS.format('text')} AS letters, length(text) - length(regexp_replace(text, '[.!?。！？]', '', 'g')) AS marks,
len(list_filter({_LINES}, lambda x: {_LETTERS.format('x')} >= 80)) AS paragraphs, length(text) - length(replace(text, chr(65533), '')) AS broken FROM documents)
SELECT doc_id, CASE WHEN url IS NULL THEN 'not fetched' WHEN regexp_matches(lower(coalesce(title, '')), 'page not found|access denied|just a moment|verify you are human|error 404|404 not found|seite nicht gefunden|página no encontrada|page introuvable|security check|consent required') THEN 'error title' WHEN text IS NULL OR trim(text, ' ') = '' THEN 'no body'
WHEN length(text) < 600 OR letters < 300 THEN 'short' WHEN marks < 3 AND paragraphs < 3 THEN 'no structure' WHEN broken > greatest(2.0, length(text) * 0.005) THEN 'broken characters' ELSE 'usable' END AS status,
letters, marks, paragraphs FROM m""",
    "hint_terms": f"WITH t AS (SELECT record_id, array_to_string(list_sort(list_filter([{_TERMS}], lambda x: x IS NOT NULL)), ',') AS terms FROM timeline_data) SELECT * FROM t WHERE terms <> ''",
    "support_terms": """SELECT doc_id, contains(lower(text), 'terminal') AND contains(lower(text), 'port') AS supports_port, contains(lower(text), 'strike') AND contains(lower(text), 'workers') AND contains(lower(text), 'dock') AS supports_strike
FROM documents WHERE text IS NOT NULL""",
    "excerpt_truncate": r"""WITH e AS (SELECT doc_id, length(text) > 900 AS cut, CASE WHEN length(text) > 900 AND contains(substr(text, 821, 80), ' ') THEN regexp_replace(substr(text, 1, 900), ' [^ ]*$', '') ELSE substr(text, 1, 900) END AS excerpt FROM documents)
SELECT doc_id, length(excerpt) AS n_chars, md5(excerpt) AS digest, coalesce(cut, false) AS truncated FROM e""",
    "line_range_excerpt": f"SELECT doc_id, concat_ws(chr(10) || '[…]' || chr(10), array_to_string({_LINES}[2:4], chr(10)), array_to_string({_LINES}[6:6], chr(10))) AS excerpt, '2–4, 6' AS label FROM documents",
    "text_guards": r"""WITH w AS (SELECT *, CASE WHEN language = 'german' THEN '=' ELSE '' END || coalesce(title, '') AS written FROM timeline_data)
SELECT record_id, CASE WHEN regexp_matches(written, '^[=+\-@]') THEN '''' || written ELSE written END AS sheet_cell, regexp_replace(replace(title, '|', '\|'), '[\r\n]+', ' ', 'g') AS table_cell,
regexp_full_match(id, '[a-z0-9][a-z0-9_-]{2,63}') AS slug, regexp_full_match(publisher, '[a-z0-9][a-z0-9_-]{2,63}') AS publisher_slug FROM w""",
    "secret_scan": f"""WITH d AS (SELECT topic, doc_id, n_chars, concat_ws(' ', text, [{', '.join(f"'{x}'" for x in _PLANTED)}][doc_id % 50 + 1]) AS t,
  [{', '.join(f"'{x}'" for x in _PLACES)}][doc_id % 7 + 1] || doc_id || CASE WHEN topic = 'rail' THEN '.log' ELSE '.txt' END AS name FROM documents),
k AS (SELECT *, array_to_string(list_filter([CASE WHEN regexp_matches(t, '-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----') THEN 'private key' END, CASE WHEN regexp_matches(t, 'github_pat_[A-Za-z0-9_]{{20,}}') THEN 'fine-grained token' END,
  CASE WHEN regexp_matches(t, 'gh[pousr]_[A-Za-z0-9]{{30,}}') THEN 'service token' END, CASE WHEN regexp_matches(t, 'AKIA[0-9A-Z]{{16}}') THEN 'access key' END, CASE WHEN regexp_matches(t, 'sk-[A-Za-z0-9]{{32,}}') THEN 'model key' END,
  CASE WHEN regexp_matches(t, 'xox[baprs]-[A-Za-z0-9-]{{20,}}') THEN 'chat token' END], lambda x: x IS NOT NULL), ',') AS kinds FROM d)
SELECT kinds, CASE WHEN regexp_matches(name, '^(cache|historical)/|[.]log$|/backup|/[.]env') THEN 'forbidden path' WHEN n_chars * 40 > 2000000 THEN 'too large' END AS path_issue, count(*) AS n_documents FROM k GROUP BY 1, 2""",
    "claimed_time_rules": r"""WITH c AS (SELECT record_id, claimed_timestamp.value AS v, claimed_timestamp.precision AS p FROM synthetic_investigation WHERE claimed_timestamp IS NOT NULL),
u AS (SELECT *, CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$') THEN
  epoch(try_strptime(regexp_replace(substr(v, 1, 16) || CASE WHEN substr(v, 17, 1) = ':' THEN substr(v, 17, 3) ELSE ':00' END, ' ', 'T'), '%Y-%m-%dT%H:%M:%S'))
  - CASE WHEN right(v, 1) = 'Z' THEN 0 ELSE (CASE WHEN substr(v, -6, 1) = '-' THEN -1 ELSE 1 END) * (substr(v, -5, 2)::INT * 3600 + substr(v, -2, 2)::INT * 60) END END AS s FROM c),
d AS (SELECT *, CASE WHEN p IS NULL OR p NOT IN ('date', 'datetime') THEN 'precision must be date or datetime'
  WHEN p = 'date' AND NOT coalesce(regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') AND try_cast(v AS DATE) IS NOT NULL, false) THEN 'date precision needs a day'
  WHEN p = 'datetime' AND s IS NULL THEN 'datetime needs an explicit offset' ELSE 'ok' END AS problem FROM u)
SELECT record_id, problem, CASE WHEN problem = 'ok' THEN s::BIGINT END AS utc_second FROM d""",
    "copied_lines": f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line FROM documents)
SELECT md5(line) AS digest, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_doc FROM l WHERE length(line) >= 60 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""",
}
