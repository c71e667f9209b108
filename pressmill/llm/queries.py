"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import html as H
from pressmill.functions import labels
from pressmill.functions import text as T
from pressmill.functions import urls as U
from pressmill.llm import langid, leaks, mixing, names, neardup, pieces
from pressmill.plans.pages import _written
from pressmill.shared import materialize, ship
from pressmill.tables import table


def _publishers(spark, folder: str) -> DataFrame:
    both = table(spark, folder, "timeline_data").select("publisher").unionAll(table(spark, folder, "synthetic_investigation").select("publisher"))
    return names.publisher_groups(both, "publisher")


def p1_found(spark, folder: str) -> DataFrame:
    """Pairs of different spellings of one publisher."""
    return names.group_pairs(_publishers(spark, folder))


def p1_groups(spark, folder: str) -> DataFrame:
    """Every spelling that has variants, its group and the group's size."""
    groups = _publishers(spark, folder)
    return groups.join(groups.groupBy("group_id").agg(F.count("*").alias("n_spellings")), "group_id").select("name", "group_id", "n_spellings")


def _labelled(spark, folder: str) -> DataFrame:
    """All labelled texts: src_table, record_id, label, detected."""
    documents = table(spark, folder, "documents")
    detect = langid.language_udf(spark, langid.fit_from(documents, "doc_id", "text", "lang"))
    # each page is read once: its own label and its sources' labels are held against the same result
    pages = materialize(documents.select("doc_id", "lang", detect("text").alias("detected")), "page-languages")
    titles = table(spark, folder, "timeline_data").select(F.lit("timeline_data").alias("src_table"), "record_id", F.col("language").alias("label"), detect("title").alias("detected"))
    own = pages.select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("record_id"), F.col("lang").alias("label"), "detected")
    sources = table(spark, folder, "evidence_sources").where("doc_id is not null").select("record_id", "language", "doc_id")
    linked = sources.join(pages.select("doc_id", "detected"), "doc_id").select(F.lit("evidence_sources").alias("src_table"), "record_id", F.col("language").alias("label"), "detected")
    return titles.unionAll(own).unionAll(linked)


def p3_found(spark, folder: str) -> DataFrame:
    """Records whose language label is missing or wrong or whose text mixes languages, one row per language."""
    return langid.label_cases(_labelled(spark, folder), "detected", "label").select("src_table", "record_id", "language")


_LABELLED = (("timeline_data", "language"), ("evidence_sources", "language"), ("documents", "lang"))


def p3_labels(spark, folder: str) -> DataFrame:
    """What the labels of the three tables name, before any text is read."""
    out = None
    for name, column in _LABELLED:
        rows = table(spark, folder, name).select(F.lit(name).alias("src_table"), labels.label_language(F.col(column)).alias("named"))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("src_table", "named").agg(F.count("*").alias("n_rows"))


def p3_segments(spark, folder: str) -> DataFrame:
    """Language and confidence of every segment of every page text."""
    documents = table(spark, folder, "documents")
    model = langid.fit_from(documents, "doc_id", "text", "lang")
    return langid.segment_languages(documents, "text", model, ["doc_id"]).withColumn("confidence", F.round("confidence", 4))


def page_quality_gates(spark, folder: str) -> DataFrame:
    """The gate of the whole cascade each document's page stops at, with the model's five best languages and chunk agreement.

    Pages are those written around the documents, as HTML without a content encoding; a redirect to the home
    page is known where a source asked for an address with a path.
    """
    ship(spark)
    documents = table(spark, folder, "documents")
    with_path = lambda c: F.trim(F.replace(U.path(F.col(c)), F.lit("/"), F.lit(""))) != ""
    asked = table(spark, folder, "evidence_sources").where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(with_path("url")).alias("asked"))
    html = H.decoded(F.encode(_written(), "UTF-8"), F.lit(None).cast("string"))
    read = documents.select("doc_id", "url", "text", html.alias("html")).withColumn("m", H.page_metadata("html"))
    read = read.withColumn("read", T.quality_status(F.col("url").isNotNull(), F.col("m.title"), F.col("text")))
    vote = langid.vote_udf(spark, langid.fit_from(documents, "doc_id", "text", "lang", furniture=frozenset()))  # votes read whole texts
    # a page that stops at a gate on its title and text alone needs no votes
    voted = read.withColumn("v", vote(F.when(F.col("read") == "usable", F.col("text"))))
    disagrees = labels.label_language(F.col("m.lang")) != F.get("v.languages", F.lit(0))
    pages = voted.select(
        "doc_id", "read", F.lit("text/html").alias("content_type"), (F.col("html").isNotNull() | F.col("text").isNull()).alias("decoded"), (~with_path("url")).alias("home"), F.col("m.has_article").alias("has_article"), "v", disagrees.alias("disagrees"),
    )
    # only measures meet the sources, not texts
    rows = pages.join(asked, "doc_id", "left")
    status = T.page_status(
        F.col("read"), F.col("content_type"), F.col("decoded"), F.col("asked") & F.col("home"), F.col("has_article"), F.col("v.score"), F.col("v.margin"), F.col("v.margin_per_letter"), F.col("v.agreement"), F.col("disagrees"),
    )
    return rows.select("doc_id", status.alias("status"), F.when(F.size("v.languages") > 0, F.col("v.languages")).alias("languages"), F.round("v.agreement", 6).alias("agreement"), F.round("v.margin_per_letter", 6).alias("margin_per_letter"))


def _recurring(spark, folder: str) -> DataFrame:
    """Texts of timeline events and imported articles that the likeness of words can compare."""
    titles = table(spark, folder, "timeline_data").select(F.lit("timeline_data").alias("src_table"), "id", F.concat(F.col("title"), F.lit(" "), F.coalesce("syndication", F.lit(""))).alias("text"))
    excerpts = table(spark, folder, "synthetic_investigation").select(F.lit("synthetic_investigation").alias("src_table"), "id", F.col("excerpt").alias("text"))
    rows = titles.unionAll(excerpts)
    return rows.where(F.col("text").isNotNull() & F.col("id").isNotNull() & ~neardup.has_han(F.col("text")))


def p5_found(spark, folder: str) -> DataFrame:
    """Pairs of different ids whose words are alike at 0.75 or more."""
    sets = neardup.word_sets(_recurring(spark, folder), "src_table", "id", "text")
    classes = neardup.similar_classes(sets, "src_table", 0.75)
    return neardup.member_pairs(sets, classes, "src_table", "id").select("src_table", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p5_groups(spark, folder: str) -> DataFrame:
    """Every compared text's id with its word set, its group of recurring texts and its set's links."""
    sets = neardup.word_sets(_recurring(spark, folder), "src_table", "id", "text")
    classes = materialize(neardup.similar_classes(sets, "src_table", 0.75), "classes")
    return neardup.grouped_records(sets, classes, "src_table", "id")


def _leaks(spark, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p6_found(spark, folder: str) -> DataFrame:
    """Documents that hold 18 consecutive words of an evaluation item."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark, folder: str) -> DataFrame:
    """For every evaluation item, in how many documents it leaks and how many passages of it at most."""
    found = _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("passages").alias("most_passages"))
    items = table(spark, folder, "eval_items").select("item_id", "suite")
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_passages", F.lit(0)).alias("most_passages"))


def p7_mix(spark, folder: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p7_shares(spark, folder: str) -> DataFrame:
    """Target and actual share of every source of the mix."""
    return mixing.shares(p7_mix(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    cut = pieces.split_texts(table(spark, folder, "documents"), "doc_id", "text", oversized_only=True, with_text=False)
    return cut.where("piece = 1").select("doc_id")


def p8_pieces(spark, folder: str) -> DataFrame:
    """All pieces of all documents."""
    return pieces.split_texts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p3_labels": p3_labels,
    "page_quality_gates": page_quality_gates,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
}
_NAMES = ", ".join(f"('{name}', '{language}')" for language, ns in labels.LABELS.items() for name in ns.split())
_NONE = ", ".join(f"'{x}'" for x in labels.NO_LANGUAGE)
SQL: dict[str, str] = {
    "p3_labels": f"""WITH names(label, language) AS (VALUES {_NAMES}), l AS ({' UNION ALL '.join(f"SELECT '{t}' AS src_table, lower(trim({c}, ' ')) AS low FROM {t}" for t, c in _LABELLED)}),
k AS (SELECT src_table, low, coalesce(a.language, b.language) AS known FROM l LEFT JOIN names a ON a.label = low LEFT JOIN names b ON b.label = regexp_extract(low, '^([\\p{{L}}]{{2,3}})[-_]', 1))
SELECT src_table, CASE WHEN low IS NULL OR low IN ({_NONE}) THEN NULL WHEN known IS NOT NULL THEN known WHEN regexp_matches(low, '^\\p{{L}}{{2,}}') THEN 'other' END AS named, count(*) AS n_rows FROM k GROUP BY 1, 2""",
}
