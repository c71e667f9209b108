"""Scans of archive files: strict tab-separated lines, zip members, reassembled records, documents, listings, caches."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.shared import ship

_START = re.compile(r"\d{14}-T\d+")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-document JSON arrays with a declared schema; file name and digest of the bytes kept."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    digests = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))
    return rows.join(digests, "file", "left")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole text files, numbered from one."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return pages.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n", -1)).alias("at", "line")).select("file", (F.col("at") + 1).alias("number"), "line")


def tsv_lines(spark: SparkSession, path: str, arity: int, on_bad_utf8: str = "reject") -> DataFrame:
    """(file, row_number, status, fields): every physical line; status ok, wrong_shape or bad_utf8.

    on_bad_utf8: reject keeps such lines without fields, replace reads them with replacement characters.
    Lines are read as bytes and judged by JVM expressions. A file is one partition, so that its lines can be
    numbered as they are read: a split in the middle would not know how many lines came before.
    """
    text = spark.read.option("lineSep", "\n").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("b"))
    # one character for each byte, so that cutting at line ends and tabs cannot break one
    latin = text.select("file", F.decode("b", "ISO-8859-1").alias("t"))
    lines = latin.select("file", F.posexplode(F.split(F.regexp_replace("t", r"\n\z", ""), "\n", -1)).alias("at", "line"), F.length("t").alias("size")).where("size > 0")
    raw = F.encode(F.regexp_replace("line", r"\r+\z", ""), "ISO-8859-1")
    rows = lines.select("file", (F.col("at") + 1).cast("bigint").alias("row_number"), raw.alias("raw"))
    good = F.is_valid_utf8(F.col("raw").cast("string"))
    fields = F.split(F.make_valid_utf8(F.col("raw").cast("string")), "\t", -1)
    kept = F.when(good | F.lit(on_bad_utf8 != "reject"), fields)
    status = F.when(kept.isNull(), "bad_utf8").when(F.size(kept) == arity, "ok").otherwise("wrong_shape")
    return rows.select("file", "row_number", status.alias("status"), kept.alias("fields"))


def zip_lines(spark: SparkSession, path: str, most_bytes: int = 200_000_000) -> DataFrame:
    """(file, member, row_number, line) of all zip members; an archive whose directory states more than ``most_bytes`` is refused."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def scan(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    if sum(m.file_size for m in archive.infolist()) > most_bytes:
                        raise ValueError(f"{file} expands beyond {most_bytes} bytes")
                    for member in archive.infolist():
                        rows = []
                        with archive.open(member) as handle:
                            for number, raw in enumerate(handle, 1):
                                rows.append((file, member.filename, number, raw.rstrip(b"\r\n").decode("utf-8", "replace")))
                                if len(rows) >= 10_000:
                                    yield pd.DataFrame(rows, columns=["file", "member", "row_number", "line"])
                                    rows = []
                        yield pd.DataFrame(rows, columns=["file", "member", "row_number", "line"])

    return files.mapInPandas(scan, "file string, member string, row_number bigint, line string")


def is_record_start(line: Column, arity: int = 27) -> Column:
    """A line of full arity whose first field is a translated record's id."""
    return (F.size(F.split(line, "\t", -1)) == arity) & line.rlike(r"^\d{14}-T\d+\t")


def reassemble(lines: DataFrame, group: str, number: str, line: str, start: Column) -> DataFrame:
    """Records of several lines: a start line and the lines without tab after it, joined by line feeds.

    Lines with a tab that start no record, and lines before the first start, are errors
    and come out with ``broken`` set instead of being joined silently. ``group`` is a
    file: its lines are numbered in one window partition, which a file's size bounds.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(number)
    rows = lines.withColumn("_start", F.coalesce(start, F.lit(False)))
    rows = rows.withColumn("record", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stray = ~F.col("_start") & (F.contains(line, F.lit("\t")) | (F.col("record") == 0))
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(line).alias("t"))))
    out = rows.withColumn("_stray", stray).groupBy(group, "record").agg(
        F.min(number).alias("first_line"), (F.count("*") - 1).alias("continuations"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("content"), F.bool_or("_stray").alias("broken")
    )
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bytes, md5, url, batch) of manifest lines, plain or gzipped; other lines are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where((F.size("p") == 3) & F.get("p", F.lit(0)).rlike(r"^\d+$"))
    batch = F.regexp_extract(F.get("p", F.lit(2)), r"(?i)/(\d{14})\.", 1)
    return parts.select(F.get("p", F.lit(0)).cast("bigint").alias("bytes"), F.get("p", F.lit(1)).alias("md5"), F.get("p", F.lit(2)).alias("url"), F.nullif(batch, F.lit("")).alias("batch"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Objects of saved XML listing pages; pages that declare a document type, or are not the whole listing, are refused.

    The pages of a whole listing form one chain: a first page without a continuation token, then each
    page's next token asked for by exactly one other, up to one page that is not truncated. A single
    document that has no mark of paging at all is an unpaged listing.
    """
    pages = spark.read.text(path, wholetext=True)
    if not pages.where(F.upper("value").rlike("<!(DOCTYPE|ENTITY)")).isEmpty():
        raise ValueError("a listing page declares a document type")
    value = lambda name: F.nullif(F.trim(F.regexp_extract("value", rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</", 1)), F.lit(""))
    marks = [(r.truncated, r.token, r.next) for r in pages.select(F.lower(value("IsTruncated")).alias("truncated"), value("ContinuationToken").alias("token"), value("NextContinuationToken").alias("next")).collect()]
    if marks != [(None, None, None)]:
        _prove_whole(marks)
    return spark.read.format("xml").option("rowTag", "Contents").schema("Key string, LastModified string, ETag string, Size bigint").load(path)


def _prove_whole(marks: list[tuple[str | None, str | None, str | None]]) -> None:
    """Raise unless pages (truncated, token, next token) are one chain from a first page to an untruncated last one."""
    by_token = {token: (truncated, following) for truncated, token, following in marks}
    if len(by_token) != len(marks):
        raise ValueError("two listing pages answer the same continuation token")
    at, seen = None, set()
    while True:
        if at not in by_token or at in seen:
            raise ValueError("the listing is incomplete: a page is missing or its tokens run in a circle")
        seen.add(at)
        truncated, following = by_token[at]
        if truncated not in ("true", "false") or (truncated == "true") != (following is not None):
            raise ValueError("the listing is incomplete: a page doesn't state whether another follows")
        if truncated == "false":
            break
        at = following
    if len(seen) != len(marks):
        raise ValueError("listing pages belong to no chain")


def newest_responses(meta: DataFrame, bodies: DataFrame) -> DataFrame:
    """The newest attempt of each cached request with its body; ``intact`` tells whether the digest still holds."""
    last = meta.groupBy("cache_key").agg(F.max(F.struct("attempt", "status", "sha256", "file")).alias("m")).select("cache_key", "m.*")
    return last.join(bodies.select("file", "content"), "file", "left").withColumn("intact", F.sha2("content", 256) == F.col("sha256"))


def cache_key(method: str, url: str) -> str:
    return hashlib.sha256(f"{method} {url}".encode()).hexdigest()
