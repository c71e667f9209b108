"""Article cards: categories, duplicate states, filters, folding, counts and references.

Folding keeps a confirmed group's first eligible member. Groups may be of any size, so
first members come from an aggregate joined back, never from a window over a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = {"related": "On this story", "unrelated": "Different story", "uncertain": "Not settled"}


def category(relevance: Column) -> Column:
    """related, unrelated or, for anything else, uncertain."""
    return F.when(relevance.isin("related", "unrelated"), relevance).otherwise("uncertain")


def category_label(name: Column) -> Column:
    return F.when(name == "related", LABELS["related"]).when(name == "unrelated", LABELS["unrelated"]).otherwise(LABELS["uncertain"])


def cards(articles: DataFrame) -> DataFrame:
    """Articles with category, copy group (digest of a non-blank excerpt), group size and duplicate state.

    A group is confirmed if it holds two different articles; a declared possible copy
    counts only where no group confirms it.
    """
    body = F.when(F.trim("excerpt") != "", F.md5("excerpt"))
    rows = articles.withColumn("copy_group", body).withColumn("category", category(F.col("relevance")))
    sizes = rows.where("copy_group is not null").groupBy("copy_group").agg(F.countDistinct("id").alias("group_size"))
    rows = rows.join(sizes, "copy_group", "left")
    state = F.when(F.col("group_size") > 1, "confirmed").when(F.col("duplicate_status") == "possible", "possible").otherwise("unassessed")
    return rows.withColumn("duplicate_state", state).withColumn("inspected", F.coalesce("inspected", F.lit(True)))


def eligible(rows: DataFrame, unrelated: bool = True, possible: bool = True, inventory: bool = False) -> DataFrame:
    """The cohort (inspected rows, or all) without the kinds that are switched off."""
    return rows.where((F.lit(inventory) | F.col("inspected")) & (F.lit(unrelated) | (F.col("category") != "unrelated")) & (F.lit(possible) | (F.col("duplicate_state") != "possible")))


def fold(rows: DataFrame, position: str = "record_id") -> DataFrame:
    """Adds ``folded``: true for confirmed copies after the first eligible one of their group."""
    first = rows.where("duplicate_state = 'confirmed'").groupBy("copy_group").agg(F.min(position).alias("first_position"))
    rows = rows.join(first, "copy_group", "left")
    return rows.withColumn("folded", F.coalesce((F.col("duplicate_state") == "confirmed") & (F.col(position) > F.col("first_position")), F.lit(False)))


def counts_matrix(rows: DataFrame) -> DataFrame:
    """The nine counts of the cohort for all sixteen settings: cohort, visible, filtered, folded, and of the
    visible rows those inspected, not inspected, related, unrelated and uncertain.

    Folded rows are the copies after a group's first eligible row (by ``record_id``), whose kind stays visible.

    Rows are first counted by what the settings look at, then each count meets the
    settings, so the sixteenfold work is on groups.
    """
    group = F.when(F.col("duplicate_state") == "confirmed", F.col("copy_group"))
    kinds = rows.groupBy("inspected", "category", "duplicate_state", group.alias("g")).agg(F.count("*").alias("n"), F.min("record_id").alias("first"))
    switch = lambda k: F.array(F.lit(False), F.lit(True))
    for name in ("inventory", "unrelated", "possible"):
        kinds = kinds.withColumn(name, F.explode(switch(name)))
    cohort = F.col("inventory") | F.col("inspected")
    allowed = cohort & (F.col("unrelated") | (F.col("category") != "unrelated")) & (F.col("possible") | (F.col("duplicate_state") != "possible"))
    settings = ["inventory", "unrelated", "possible"]
    shown = {"n_visible": F.lit(True), "visible_inspected": F.col("inspected"), "visible_uninspected": ~F.col("inspected"), **{f"{k}_visible": F.col("category") == k for k in ("related", "unrelated", "uncertain")}}
    eligible = {name: F.sum(F.when(allowed & kind, F.col("n")).otherwise(0)).alias(name) for name, kind in shown.items()}
    # what a group keeps when folded: one row, of the kind of its first eligible one
    kept = F.min(F.when(allowed, F.struct("first", "inspected", "category"))).alias("kept")
    by_group = kinds.groupBy(*settings, "g").agg(F.sum(F.when(cohort, F.col("n")).otherwise(0)).alias("n_cohort"), *eligible.values(), kept)
    by_group = by_group.withColumn("fold", F.explode(switch("fold")))
    folded = F.col("fold") & F.col("g").isNotNull()
    one = {"n_visible": F.col("kept").isNotNull(), "visible_inspected": F.col("kept.inspected"), "visible_uninspected": ~F.col("kept.inspected"), **{f"{k}_visible": F.col("kept.category") == k for k in ("related", "unrelated", "uncertain")}}
    left = [F.sum(F.when(folded, F.coalesce(one[name], F.lit(False)).cast("int")).otherwise(F.col(name))).alias(name) for name in shown]
    extra = F.when(folded, F.col("n_visible") - F.col("kept").isNotNull().cast("int")).otherwise(0)
    sums = by_group.groupBy(*settings, "fold").agg(F.sum("n_cohort").alias("n_cohort"), F.sum("n_visible").alias("n_eligible"), F.sum(extra).alias("n_folded"), *left)
    return sums.select(*settings, "fold", "n_cohort", "n_folded", (F.col("n_cohort") - F.col("n_eligible")).alias("n_filtered"), *shown)


def sibling_rows(rows: DataFrame) -> DataFrame:
    """Every confirmed copy beside each other article of its group: record_id, id, sibling's record_id, id, title and publisher.

    As many rows as a group has pairs, which is what is asked of one article; ``siblings`` has the groups alone.
    """
    confirmed = rows.where("duplicate_state = 'confirmed'")
    other = confirmed.select(F.col("copy_group").alias("g"), F.col("record_id").alias("sibling_record"), F.col("id").alias("sibling_id"), F.col("title").alias("sibling_title"), F.col("publisher").alias("sibling_publisher"))
    return confirmed.select("record_id", "id", "copy_group").join(other, F.col("copy_group") == F.col("g")).where("id <> sibling_id").drop("g", "copy_group")


def single(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error unless there is exactly one."""
    counted = rows.agg(F.count("*").alias("n"), F.first(F.struct(*rows.columns)).alias("r"))
    return counted.select(F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit(f"expected one {what}, found "), F.col("n").cast("string")))).alias("r")).select("r.*")


def siblings(rows: DataFrame) -> DataFrame:
    """Per confirmed copy: its group, the group's first and last member and how many other articles it has."""
    confirmed = rows.where("duplicate_state = 'confirmed'")
    groups = confirmed.groupBy("copy_group").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return confirmed.join(groups, "copy_group").select("record_id", "id", "copy_group", "first_id", "last_id", (F.col("group_size") - 1).alias("n_siblings"))


def ordered(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """Numbers within each collection: listed categories first in the order given, then by position."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranks)), F.col("category")), F.lit(0).cast("bigint")), F.lit(len(ranks) + 1).cast("bigint"))
    order = Window.partitionBy("investigation_id").orderBy(rank, "record_id")  # a collection has at most 500 articles
    return rows.withColumn("number", F.row_number().over(order))


def origin_label(origin: Column) -> Column:
    return (
        F.when(origin.isNull(), "Not recorded").when(origin.startswith("archive"), "Archive result").when(origin == "external_web_discovery", "External page")
        .when(origin.contains("metadata"), "Metadata only").otherwise("Other")
    )


def references(notes: DataFrame, articles: DataFrame) -> DataFrame:
    """Each note's source ids, and whether the collection has such an article, with its title."""
    refs = notes.select("investigation_id", F.col("id").alias("note_id"), F.explode("source_ids").alias("source_id"))
    known = articles.groupBy("investigation_id", F.col("id").alias("source_id")).agg(F.min_by("title", "record_id").alias("title"), F.lit(True).alias("known"))
    return refs.join(known, ["investigation_id", "source_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def claim_label(claim: Column) -> Column:
    """How a claimed time is shown: a day never gains a clock, a clock is shown in UTC only if the offset is stated as zero."""
    return (
        F.when(claim.isNull(), "no time claimed").when(claim.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(claim, F.lit(" (day only)")))
        .when(claim.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\+00:00|Z)$"), F.concat(F.substring(claim, 1, 10), F.lit(" "), F.substring(claim, 12, 5), F.lit(" UTC")))
        .otherwise("as claimed")
    )


def override(rows: DataFrame, reviews: DataFrame, key: str, machine: str, reviewed: str) -> DataFrame:
    """A review's value where there is one, else the machine's."""
    joined = rows.join(reviews, key, "left")
    return joined.withColumn("value", F.coalesce(reviewed, machine)).withColumn("overridden", F.coalesce(F.col(reviewed) != F.col(machine), F.col(reviewed).isNotNull()))
