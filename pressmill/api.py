"""Functions over a store of collections; results are DataFrames, failures are typed exceptions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators import evidence as E
from pressmill.store import NotFound, Store

TEMPLATE = {
    "schema_version": 1, "id": "my-collection", "title": "Title of the collection", "topic": "topic",
    "articles": [{"id": "first-article", "title": "A headline", "publisher": "A newsroom", "language": "english", "relevance": "related", "url": "https://news.example/first"}],
}


def flag(value: str | None, default: bool) -> bool:
    """A 0/1 parameter; anything else is an error, absence the default."""
    if value is None:
        return default
    if value not in ("0", "1"):
        raise ValueError("a flag is 0 or 1")
    return value == "1"


def import_template() -> str:
    return json.dumps(TEMPLATE, indent=2)


def list_collections(store: Store) -> DataFrame:
    return store.listed()


def _cards(store: Store, collection: str) -> DataFrame:
    """A collection's cards; here the declared group and status decide, not the text."""
    rows = store.articles(collection)
    if rows.isEmpty():
        raise NotFound(collection)
    rows = rows.withColumn("category", E.category(F.col("relevance"))).withColumn("duplicate_state", F.col("duplicate_status"))
    sizes = rows.groupBy("duplicate_group").agg(F.count("*").alias("group_size"))
    return rows.join(sizes, "duplicate_group").withColumn("copy_group", F.col("duplicate_group"))


def evidence(store: Store, collection: str, unrelated: bool = True, possible: bool = True, fold: bool = False, inventory: bool = False) -> DataFrame:
    """The visible cards in order."""
    rows = E.fold(E.eligible(_cards(store, collection), unrelated, possible, inventory))
    visible = rows.where(~F.col("folded")) if fold else rows
    return visible.select("record_id", "id", "title", "publisher", "language", "url", "category", E.category_label(F.col("category")).alias("category_label"), "duplicate_state", "group_size").orderBy("record_id")


def evidence_counts(store: Store, collection: str) -> DataFrame:
    return E.counts_matrix(_cards(store, collection))


def source_detail(store: Store, collection: str, article: str) -> DataFrame:
    """One article with its confirmed copies and the notes that cite it."""
    rows = _cards(store, collection)
    one = rows.where(F.col("id") == article)
    if one.isEmpty():
        raise NotFound(article)
    group = one.select("duplicate_group").first()[0]
    same = rows.where((F.col("duplicate_group") == group) & (F.col("duplicate_state") == "confirmed") & (F.col("id") != article))
    copies = sorted(r.id for r in same.select("id").collect())  # a collection has at most 500 articles and 50 notes
    notes = store.collections().where(F.col("id") == collection).select(F.explode("uncertainties").alias("n")).where(F.array_contains("n.source_ids", article))
    cited = sorted(r.id for r in notes.select("n.id").collect())
    as_array = lambda ids: F.array(*map(F.lit, ids)).cast("array<string>")
    shown = one.select("id", "title", "publisher", "url", "category", "duplicate_state", "excerpt", E.claim_label(F.col("claimed_timestamp.value")).alias("claim_label"))
    return shown.withColumn("copies", as_array(copies)).withColumn("notes", as_array(cited))


def timeline(store: Store, collection: str, day: str = "all") -> DataFrame:
    """Events of the articles to be replayed, by day and id; an unknown day is an error, not an empty answer."""
    rows = _cards(store, collection).where("include_in_replay and claimed_timestamp is not null")
    rows = rows.select("id", "title", "publisher", F.substring("claimed_timestamp.value", 1, 10).alias("day"), E.claim_label(F.col("claimed_timestamp.value")).alias("claim_label"))
    if day != "all":
        rows = rows.where(F.col("day") == day)
        if rows.isEmpty():
            raise NotFound(day)
    return rows.orderBy("day", "id")


def import_collection(store: Store, body: str | bytes) -> str:
    return store.import_body(body)


def delete_collection(store: Store, collection: str) -> None:
    store.delete(collection)
