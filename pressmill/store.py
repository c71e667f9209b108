"""A folder of imported collections: one JSON file each, validated on the way in and on every scan."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators.imports import body_errors, validate

ARTICLE_TYPE = (
    "struct<id:string,title:string,publisher:string,language:string,url:string,origin_label:string,relevance:string,inspected:boolean,duplicate_group:string,duplicate_status:string,"
    "claimed_timestamp:struct<value:string,precision:string>,excerpt:string,include_in_replay:boolean>"
)
BODY_TYPE = f"struct<id:string,title:string,topic:string,description:string,articles:array<{ARTICLE_TYPE}>,uncertainties:array<struct<id:string,title:string,detail:string,source_ids:array<string>>>>"


class ImportRefused(ValueError):
    """A body with errors; ``errors`` has all of them."""

    def __init__(self, errors: list[tuple[str, str]]):
        super().__init__("; ".join(f"{p}: {m}" for p, m in errors))
        self.errors = errors


class NotFound(LookupError):
    """No such collection, article or day."""


class Forbidden(PermissionError):
    """The collection may not be changed."""


class Store:
    """Collections by id. Bundled ones shadow stored files of the same id and cannot be deleted;
    of two files with one id the later name wins; files with errors are set aside, not read."""

    def __init__(self, spark: SparkSession, folder: str, bundled: dict[str, str] | None = None):
        self.spark, self.folder, self.bundled = spark, Path(folder), bundled or {}
        self.folder.mkdir(parents=True, exist_ok=True)

    def bodies(self) -> DataFrame:
        """(file, imported_at, body, origin) of all files and bundled bodies."""
        files = sorted(self.folder.glob("*.json"))
        stored = None
        if files:
            scan = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(str(self.folder))
            stored = scan.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("modificationTime").alias("imported_at"), F.col("content").cast("string").alias("body"), F.lit("imported").alias("origin"))
        own = self.spark.createDataFrame([(f"bundled:{k}", None, v, "bundled") for k, v in self.bundled.items()], "file string, imported_at timestamp, body string, origin string")
        return own if stored is None else own.unionByName(stored)

    def errors(self) -> DataFrame:
        return validate(self.bodies(), "file", "body")

    def collections(self) -> DataFrame:
        """Valid collections, one per id: id, title, topic, origin, imported_at, articles, uncertainties."""
        bad = self.errors().select("file").distinct()
        rows = self.bodies().join(bad, "file", "left_anti").withColumn("c", F.from_json("body", BODY_TYPE))
        rank = F.struct((F.col("origin") == "bundled").alias("b"), F.col("file").alias("f"))
        last = rows.groupBy("c.id").agg(F.max_by(F.struct("origin", "imported_at", "c"), rank).alias("r"))
        return last.select("id", "r.c.title", "r.c.topic", "r.origin", "r.imported_at", "r.c.articles", "r.c.uncertainties")

    def listed(self) -> DataFrame:
        """Bundled collections first, then by import time."""
        rows = self.collections().select("id", "title", "topic", "origin", "imported_at", F.size("articles").alias("n_articles"))
        return rows.orderBy(F.when(F.col("origin") == "bundled", 0).otherwise(1), "imported_at", "id")

    def articles(self, collection: str) -> DataFrame:
        """The articles of a collection with position, defaults filled in."""
        rows = self.collections().where(F.col("id") == collection).select(F.col("id").alias("investigation_id"), F.posexplode("articles").alias("position", "a"))
        out = rows.select("investigation_id", (F.col("position") + 1).cast("bigint").alias("record_id"), "a.*")
        out = out.withColumn("inspected", F.coalesce("inspected", F.lit(True))).withColumn("include_in_replay", F.coalesce("include_in_replay", F.lit(False)))
        group = F.when(F.trim("duplicate_group") != "", F.col("duplicate_group")).otherwise(F.concat(F.lit("UNASSESSED-"), "id"))
        return out.withColumn("duplicate_group", group).withColumn("duplicate_status", F.coalesce("duplicate_status", F.lit("unassessed")))

    def import_body(self, body: str | bytes) -> str:
        """Store a body and return its id; raises ImportRefused with every error."""
        errors = body_errors(body)
        if errors:
            raise ImportRefused(errors)
        parsed = json.loads(body)
        target = self.folder / f"{parsed['id']}.json"
        if parsed["id"] in self.bundled or target.exists():
            raise ImportRefused([("id", "already used by another collection")])
        target.write_text(json.dumps(parsed, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
        return parsed["id"]

    def delete(self, collection: str) -> None:
        if collection in self.bundled:
            raise Forbidden(collection)
        target = self.folder / f"{collection}.json"
        if Path(collection).name != collection or not target.exists():
            raise NotFound(collection)
        target.unlink()
