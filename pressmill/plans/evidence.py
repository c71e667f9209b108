"""Queries over imported articles, their notes and timeline events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators import evidence as E
from pressmill.tables import table


def _cards(spark, folder: str) -> DataFrame:
    columns = ["record_id", "investigation_id", "id", "title", "publisher", "relevance", "inspected", "duplicate_status", "excerpt", "include_in_replay"]
    return E.cards(table(spark, folder, "synthetic_investigation").select(*columns))


def evidence_filter(spark, folder: str) -> DataFrame:
    """Inspected articles that are not about another story."""
    rows = E.eligible(_cards(spark, folder), unrelated=False)
    return rows.select("record_id", "id", "category", E.category_label(F.col("category")).alias("category_label"), "duplicate_state")


def evidence_counts_matrix(spark, folder: str) -> DataFrame:
    """Counts for all sixteen filter settings."""
    return E.counts_matrix(_cards(spark, folder))


def evidence_fold(spark, folder: str) -> DataFrame:
    """All articles, confirmed copies after the first marked as folded."""
    return E.fold(E.eligible(_cards(spark, folder), inventory=True)).select("record_id", "id", "category", "folded")


def evidence_summary(spark, folder: str) -> DataFrame:
    """Ten conditional counts and one distinct count over the inventory."""
    c = _cards(spark, folder)
    n = lambda cond: F.count_if(F.coalesce(F.expr(cond), F.lit(False)))
    return c.agg(
        F.count("*").alias("n_articles"), n("inspected").alias("n_inspected"), n("category = 'related'").alias("n_related"), n("category = 'unrelated'").alias("n_unrelated"),
        n("category = 'uncertain'").alias("n_uncertain"), n("duplicate_state = 'confirmed'").alias("n_confirmed"), n("duplicate_state = 'possible'").alias("n_possible"),
        n("include_in_replay").alias("n_replay"), n("inspected and category = 'related'").alias("n_on_story"), n("excerpt is null or trim(excerpt) = ''").alias("n_without_text"),
        F.countDistinct(F.when(F.col("duplicate_state") == "confirmed", F.col("copy_group"))).alias("n_groups"),
    )


def evidence_siblings(spark, folder: str) -> DataFrame:
    """Confirmed copies with their group and number of other articles in it."""
    return E.siblings(_cards(spark, folder))


def evidence_sibling_rows(spark, folder: str) -> DataFrame:
    """Confirmed copies within one collection, each beside every other article of its group; a collection has at most 500."""
    rows = _cards(spark, folder).withColumn("copy_group", F.concat_ws("/", "investigation_id", "copy_group"))
    return E.sibling_rows(rows)


def evidence_ordered(spark, folder: str) -> DataFrame:
    """Articles numbered within their collection: related first, then uncertain, then the rest."""
    return E.ordered(_cards(spark, folder), ["related", "uncertain"]).select("investigation_id", "record_id", "number")


def collection_search(spark, folder: str, words: str = "  Terminal ") -> DataFrame:
    """Collections by how many of their articles' titles, publishers or ids contain the words."""
    rows = table(spark, folder, "synthetic_investigation").select("investigation_id", "record_id", F.lower(F.concat_ws(" ", "title", "publisher", "id")).alias("hay"))
    found = F.count_if(F.contains("hay", F.lit(words.strip().lower())))
    return rows.groupBy("investigation_id").agg(F.count("*").alias("n_articles"), found.alias("n_found"), F.min("record_id").alias("position")).where("n_found > 0")


def timeline_events(spark, folder: str) -> DataFrame:
    """Each timeline event's latest delivery with its labels."""
    columns = ["record_id", "display_date", "publisher", "publisher_publication_utc_claim", "retrieved_at_utc"]
    rows = table(spark, folder, "timeline_data").where("id is not null").select("id", F.struct(F.coalesce("retrieved_at_utc", F.lit("")).alias("t"), *[c for c in columns if c != "retrieved_at_utc"]).alias("d"))
    last = rows.groupBy("id").agg(F.max("d").alias("d")).select("id", "d.*")
    return last.select("id", "record_id", F.date_format("display_date", "yyyy-MM-dd").alias("day"), F.date_format("display_date", "dd/MM").alias("day_label"), "publisher", E.claim_label(F.col("publisher_publication_utc_claim")).alias("claim_label"))


def timeline_days(spark, folder: str) -> DataFrame:
    """Days that have events, and how many."""
    rows = table(spark, folder, "timeline_data").where("display_date is not null")
    return rows.groupBy(F.date_format("display_date", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("id").alias("n_events"), F.count("*").alias("n_deliveries"))


def retained_set_check(spark, folder: str) -> DataFrame:
    """Article ids that notes cite against those the collections hold: both, only cited, only held."""
    cited = table(spark, folder, "uncertainties").select("investigation_id", F.explode("source_ids").alias("id")).distinct().withColumn("c", F.lit(True))
    held = table(spark, folder, "synthetic_investigation").select("investigation_id", "id").distinct().withColumn("h", F.lit(True))
    where = F.when(F.col("c") & F.col("h"), "both").when(F.col("c"), "only cited").otherwise("only held")
    return cited.join(held, ["investigation_id", "id"], "full").groupBy(where.alias("side")).agg(F.count("*").alias("n_ids"))


def uncertainty_refs(spark, folder: str) -> DataFrame:
    """Every reference of a note, its article's title, and whether the article exists."""
    return E.references(table(spark, folder, "uncertainties"), table(spark, folder, "synthetic_investigation"))


def uncertainty_backrefs(spark, folder: str) -> DataFrame:
    """Cited articles with the notes that cite them."""
    refs = E.references(table(spark, folder, "uncertainties"), table(spark, folder, "synthetic_investigation")).where("known")
    return refs.groupBy("investigation_id", "source_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("note_id"))).alias("notes"))  # at most 50 notes


def source_origins(spark, folder: str) -> DataFrame:
    """Candidate pages by origin label."""
    rows = table(spark, folder, "evidence_sources").select(E.origin_label(F.col("origin")).alias("origin_label"), "id", "doc_id")
    return rows.groupBy("origin_label").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_sources"), F.count("doc_id").alias("n_with_page"))


def manual_override(spark, folder: str) -> DataFrame:
    """A page's own language label in place of its source's."""
    reviews = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("reviewed"))
    rows = table(spark, folder, "evidence_sources").select("record_id", "doc_id", F.col("language").alias("machine"))
    return E.override(rows, reviews, "doc_id", "machine", "reviewed").select("record_id", "value", "overridden")


QUERIES = {
    f.__name__: f
    for f in (
        evidence_filter, evidence_counts_matrix, evidence_fold, evidence_summary, evidence_siblings, evidence_sibling_rows, evidence_ordered, collection_search, timeline_events,
        timeline_days, retained_set_check, uncertainty_refs, uncertainty_backrefs, source_origins, manual_override,
    )
}

_CARDS = """WITH body AS (SELECT *, CASE WHEN trim(excerpt, ' ') <> '' THEN md5(excerpt) END AS copy_group, CASE WHEN relevance IN ('related', 'unrelated') THEN relevance ELSE 'uncertain' END AS category
  FROM synthetic_investigation),
sizes AS (SELECT copy_group, count(DISTINCT id) AS group_size FROM body WHERE copy_group IS NOT NULL GROUP BY 1),
cards AS (SELECT record_id, investigation_id, id, category, copy_group, group_size, excerpt, include_in_replay, coalesce(inspected, true) AS inspected,
  CASE WHEN group_size > 1 THEN 'confirmed' WHEN duplicate_status = 'possible' THEN 'possible' ELSE 'unassessed' END AS duplicate_state FROM body LEFT JOIN sizes USING (copy_group))"""
_REFS = """WITH refs AS (SELECT investigation_id, id AS note_id, unnest(source_ids) AS source_id FROM uncertainties),
known AS (SELECT investigation_id, id AS source_id, arg_min(title, record_id) AS title FROM synthetic_investigation GROUP BY 1, 2),
held AS (SELECT DISTINCT investigation_id, id AS source_id, true AS k FROM synthetic_investigation),
r AS (SELECT refs.investigation_id, refs.source_id, note_id, title, coalesce(k, false) AS known FROM refs LEFT JOIN known USING (investigation_id, source_id) LEFT JOIN held USING (investigation_id, source_id))"""
SQL = {
    "evidence_filter": f"""{_CARDS} SELECT record_id, id, category, CASE category WHEN 'related' THEN 'On this story' WHEN 'unrelated' THEN 'Different story' ELSE 'Not settled' END AS category_label, duplicate_state
FROM cards WHERE inspected AND category <> 'unrelated'""",
    "evidence_counts_matrix": f"""{_CARDS},
settings AS (SELECT a.v AS inventory, b.v AS unrelated, c.v AS possible, d.v AS fold FROM (VALUES (true), (false)) a(v), (VALUES (true), (false)) b(v), (VALUES (true), (false)) c(v), (VALUES (true), (false)) d(v)),
e AS (SELECT s.*, k.record_id, k.copy_group, k.duplicate_state, k.inspected, k.category, (unrelated OR category <> 'unrelated') AND (possible OR duplicate_state <> 'possible') AS ok FROM settings s, cards k WHERE inventory OR inspected),
f AS (SELECT *, ok AND fold AND duplicate_state = 'confirmed' AND record_id > min(CASE WHEN ok AND duplicate_state = 'confirmed' THEN record_id END) OVER (PARTITION BY inventory, unrelated, possible, fold, copy_group) AS folded FROM e),
v AS (SELECT *, ok AND NOT coalesce(folded, false) AS shown FROM f)
SELECT inventory, unrelated, possible, fold, count(*) AS n_cohort, count(*) FILTER (shown) AS n_visible, count(*) FILTER (folded) AS n_folded, count(*) FILTER (NOT ok) AS n_filtered,
count(*) FILTER (shown AND inspected) AS visible_inspected, count(*) FILTER (shown AND NOT inspected) AS visible_uninspected, count(*) FILTER (shown AND category = 'related') AS related_visible,
count(*) FILTER (shown AND category = 'unrelated') AS unrelated_visible, count(*) FILTER (shown AND category = 'uncertain') AS uncertain_visible FROM v GROUP BY 1, 2, 3, 4""",
    "evidence_fold": f"""{_CARDS}, f AS (SELECT copy_group, min(record_id) AS first_position FROM cards WHERE duplicate_state = 'confirmed' GROUP BY 1)
SELECT record_id, id, category, coalesce(duplicate_state = 'confirmed' AND record_id > first_position, false) AS folded FROM cards LEFT JOIN f USING (copy_group)""",
    "evidence_summary": f"""{_CARDS} SELECT count(*) AS n_articles, count(*) FILTER (inspected) AS n_inspected, count(*) FILTER (category = 'related') AS n_related, count(*) FILTER (category = 'unrelated') AS n_unrelated,
count(*) FILTER (category = 'uncertain') AS n_uncertain, count(*) FILTER (duplicate_state = 'confirmed') AS n_confirmed, count(*) FILTER (duplicate_state = 'possible') AS n_possible, count(*) FILTER (include_in_replay) AS n_replay,
count(*) FILTER (inspected AND category = 'related') AS n_on_story, count(*) FILTER (excerpt IS NULL OR trim(excerpt, ' ') = '') AS n_without_text,
count(DISTINCT CASE WHEN duplicate_state = 'confirmed' THEN copy_group END) AS n_groups FROM cards""",
    "evidence_siblings": f"""{_CARDS}, g AS (SELECT copy_group, min(id) AS first_id, max(id) AS last_id FROM cards WHERE duplicate_state = 'confirmed' GROUP BY 1)
SELECT record_id, id, copy_group, first_id, last_id, group_size - 1 AS n_siblings FROM cards JOIN g USING (copy_group) WHERE duplicate_state = 'confirmed'""",
    "evidence_sibling_rows": f"""{_CARDS.replace('SELECT record_id, investigation_id, id, category', 'SELECT record_id, investigation_id, id, title, publisher, category')}
SELECT a.record_id, a.id, b.record_id AS sibling_record, b.id AS sibling_id, b.title AS sibling_title, b.publisher AS sibling_publisher FROM cards a JOIN cards b
ON a.investigation_id = b.investigation_id AND a.copy_group = b.copy_group AND a.duplicate_state = 'confirmed' AND b.duplicate_state = 'confirmed' AND a.id <> b.id""",
    "evidence_ordered": f"""{_CARDS} SELECT investigation_id, record_id, row_number() OVER (PARTITION BY investigation_id ORDER BY CASE category WHEN 'related' THEN 1 WHEN 'uncertain' THEN 2 ELSE 3 END, record_id) AS number FROM cards""",
    "collection_search": """SELECT investigation_id, count(*) AS n_articles, count(*) FILTER (contains(lower(concat_ws(' ', title, publisher, id)), 'terminal')) AS n_found, min(record_id) AS position
FROM synthetic_investigation GROUP BY 1 HAVING n_found > 0""",
    "timeline_events": r"""WITH l AS (SELECT * FROM timeline_data WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(retrieved_at_utc, '') DESC, record_id DESC) = 1)
SELECT id, record_id, strftime(display_date, '%Y-%m-%d') AS day, strftime(display_date, '%d/%m') AS day_label, publisher, CASE WHEN publisher_publication_utc_claim IS NULL THEN 'no time claimed'
WHEN regexp_matches(publisher_publication_utc_claim, '^\d{4}-\d{2}-\d{2}$') THEN publisher_publication_utc_claim || ' (day only)'
WHEN regexp_matches(publisher_publication_utc_claim, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\+00:00|Z)$') THEN substr(publisher_publication_utc_claim, 1, 10) || ' ' || substr(publisher_publication_utc_claim, 12, 5) || ' UTC' ELSE 'as claimed' END AS claim_label FROM l""",
    "timeline_days": "SELECT strftime(display_date, '%Y-%m-%d') AS day, count(DISTINCT id) AS n_events, count(*) AS n_deliveries FROM timeline_data WHERE display_date IS NOT NULL GROUP BY 1",
    "retained_set_check": """WITH c AS (SELECT DISTINCT investigation_id, unnest(source_ids) AS id FROM uncertainties), h AS (SELECT DISTINCT investigation_id, id FROM synthetic_investigation),
j AS (SELECT c.id AS a, h.id AS b FROM c FULL JOIN h USING (investigation_id, id)) SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'only cited' ELSE 'only held' END AS side, count(*) AS n_ids FROM j GROUP BY 1""",
    "uncertainty_refs": f"{_REFS} SELECT * FROM r",
    "uncertainty_backrefs": f"{_REFS} SELECT investigation_id, source_id, string_agg(DISTINCT note_id, ',' ORDER BY note_id) AS notes FROM r WHERE known GROUP BY 1, 2",
    "source_origins": """SELECT CASE WHEN origin IS NULL THEN 'Not recorded' WHEN starts_with(origin, 'archive') THEN 'Archive result' WHEN origin = 'external_web_discovery' THEN 'External page' WHEN contains(origin, 'metadata') THEN 'Metadata only' ELSE 'Other' END AS origin_label,
count(*) AS n_rows, count(DISTINCT id) AS n_sources, count(doc_id) AS n_with_page FROM evidence_sources GROUP BY 1""",
    "manual_override": """SELECT e.record_id, coalesce(d.lang, e.language) AS value, coalesce(d.lang <> e.language, d.lang IS NOT NULL) AS overridden FROM evidence_sources e LEFT JOIN documents d USING (doc_id)""",
}
