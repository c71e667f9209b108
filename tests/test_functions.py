"""Vectors of address, text, page and import functions."""

import json

import pytest
from pyspark.sql import functions as F

from pressmill.functions import html as H
from pressmill.functions import text as T
from pressmill.functions import urls as U
from pressmill.operators import imports as I


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


@pytest.mark.parametrize(("url", "ok"), [("javascript:alert(1)", 0), ("data:text/html,x", 0), ("example.test/a", 0), ("https://user:pw@example.test/", 0), (None, 0), ("http://[bad", 1), ("https://example.test/article", 1)])
def test_safe_url(spark, url, ok):
    assert (one(spark, url, U.safe(F.col("v"))) is not None) == bool(ok)


@pytest.mark.parametrize(("url", "ok"), [("file:///etc/passwd", 0), ("http://127.0.0.1/", 0), ("http://169.254.1.1/", 0), ("http://localhost/", 0), ("http://u@a.example/", 0), ("http://a.example:22/", 0), ("https://a.example:443/x", 1), ("http://8.8.8.8/", 1)])
def test_public_url(url, ok):
    assert H.is_public(url) == bool(ok)


def test_wire_url():
    assert H.wire("http://a.example:80", True) == "https://a.example/"
    assert H.wire("http://bücher.example/ü?q=ä#f") == "http://xn--bcher-kva.example/%C3%BC?q=%C3%A4"


@pytest.mark.parametrize(("info", "want"), [("", (None, "missing")), ("eng:GT-SPA 1.0", (None, "missing")), ("srclc:spa;eng:GT-SPA 1.0", ("spa", "explicit")), ("srclc:eng", ("eng", "explicit")), ("srclc:spa;srclc:rus", (None, "conflicting")), ("srclc:und", (None, "unusable")), (None, (None, "missing"))])
def test_original_language(spark, info, want):
    assert tuple(spark.createDataFrame([(info,)], "v string").select(*T.original_language(F.col("v"))).first()) == want


def test_info_map_last_wins(spark):
    assert one(spark, "a:1;b:2;a:3", T.info_map(F.col("v"))) == {"a": "3", "b": "2"}


@pytest.mark.parametrize(("text", "want"), [("impulsan impulsando", []), ("Novorossiysk y Ulsan, ulsan", ["novorossiysk", "ulsan"]), ("éulsan", [])])
def test_terms(spark, text, want):
    assert one(spark, text, T.terms_in(F.col("v"), ["ulsan", "novorossiysk"], ["канал"])) == want


@pytest.mark.parametrize(("cell", "want"), [("=1+1", "'=1+1"), ("-x", "'-x"), ("plain", "plain"), (None, None)])
def test_sheet_guard(spark, cell, want):
    assert one(spark, cell, T.sheet_guard(F.col("v"))) == want


def test_excerpt(spark):
    text = "a" * 860 + " " + "b" * 100
    cut, flag = T.excerpt(F.col("v"))
    assert one(spark, text, cut) == "a" * 860 and one(spark, text, flag)
    assert one(spark, "c" * 950, cut) == "c" * 900
    assert one(spark, "short", flag) is False


@pytest.mark.parametrize(("value", "ok"), [("2026-09-01T10:00:00+05:30", 1), ("2026-09-01T10:00-04:00", 1), ("2026-09-01T10:00:00Z", 1), ("2026-09-01", 0), ("2026-09-01T10:00:00", 0), ("2026-09-01T10:00:00+0900", 0), (None, 0)])
def test_strict_utc(spark, value, ok):
    assert (one(spark, value, T.strict_utc_second(F.col("v"))) is not None) == bool(ok)


def test_slug_takes_no_line_end(spark):
    assert not one(spark, "abc\n", T.is_slug(F.col("v"))) and one(spark, "abc", T.is_slug(F.col("v")))


def test_visible_parts():
    page = "<html><head><title> T </title><style>x{}</style></head><body><noscript>no</noscript><p>a <b>b</b>\n c</p></style><script>var x</script>end</body>"
    assert H.visible_parts(page) == ["T", "a", "b", "c", "end"]


def test_page_dates_only_of_the_page():
    graph = {"@graph": [{"url": "https://x.example/other", "datePublished": "1"}, {"@id": "https://x.example/a/#main", "datePublished": "2"}, {"mainEntityOfPage": {"@id": "https://x.example/b"}, "datePublished": "3"}]}
    assert list(H.page_dates(graph, "https://x.example/a")) == [("datePublished", "2", "$.@graph[1].datePublished")]


def test_primary_article():
    blocks = [{"@graph": [{"@type": "NewsArticle", "url": "https://a.example/1", "articleBody": "x"}, {"@type": ["Thing", "Article"], "url": "https://a.example/2"}]}]
    assert H.primary_article(blocks, "https://a.example/2/")["url"] == "https://a.example/2"
    assert H.primary_article(blocks, "https://a.example/3") is None


@pytest.mark.parametrize(("value", "attempt", "want"), [("120", 0, 120), ("Thu, 01 Jan 1970 00:03:00 GMT", 0, 180), ("bad", 0, 30), (None, 1, 60), ("-5", 0, 30)])
def test_retry_delay(value, attempt, want):
    assert H.retry_delay(value, attempt, now=0.0) == want


def article(**extra):
    return {"id": "art-1", "title": "T", "publisher": "P", "language": "english", "relevance": "related"} | extra


def body(*articles, **extra):
    return {"schema_version": 1, "id": "col-1", "title": "T", "topic": "t", "articles": list(articles) or [article()]} | extra


@pytest.mark.parametrize(
    ("made", "path", "message"),
    [
        (body(article(url="javascript:1")), "articles[0].url", "invalid or unsafe URL scheme"),
        (body(article(), article()), "articles[1].id", "duplicate article id"),
        ({"schema_version": 1, "id": "col-1", "articles": [article()]}, "title", "required"),
        (body(article(claimed_timestamp={"value": "2030-01-01T10:00:00Z", "precision": "date"})), "articles[0].claimed_timestamp.value", "date precision"),
        (body(article(claimed_timestamp={"value": "2030-01-01T10:00:00", "precision": "datetime"})), "articles[0].claimed_timestamp.value", "explicit UTC offset"),
        (body(article(claimed_timestamp={"value": "2030-02-30", "precision": "date"})), "articles[0].claimed_timestamp.value", "not a real calendar date"),
        (body(article(include_in_replay=True)), "articles[0].include_in_replay", "true requires claimed_timestamp"),
        (body(article(surprise=1)), "articles[0].surprise", "unknown field"),
        (body(surprise=1), "surprise", "unknown field"),
        (body(article(duplicate_group="G", duplicate_status="confirmed")), "articles[0].duplicate_status", "requires at least 2 articles sharing duplicate_group"),
        (body(uncertainties=[{"id": "note-1", "title": "t", "detail": "d", "source_ids": ["ghost-id"]}]), "uncertainties[0].source_ids", "unknown article id 'ghost-id'"),
        (body(article(inspected=None)), "articles[0].inspected", "must be true or false"),
        (body(article(language="English")), "articles[0].language", "must be a lowercase word"),
        (body(description=" "), "description", "non-empty"),
        (body(schema_version=True), "schema_version", "must equal 1"),
        (body(id="abc\n"), "id", "must match"),
        (body(articles=[]), "articles", "must contain 1..500"),
        ([], "body", "must be a JSON object"),
    ],
)
def test_import_errors(made, path, message):
    assert any(p == path and message in m for p, m in I.body_errors(json.dumps(made)))


def test_valid_import_and_limits():
    assert I.body_errors(json.dumps(body())) == []
    assert I.body_errors("x" * 1_048_577) == [("body", "exceeds 1048576 bytes")]
    assert I.body_errors("{") == [("body", "not valid JSON")]
    assert I.body_errors(json.dumps(body(aggregate_context={"count": 1, "date": "2030-13-45", "language": "l", "source": "s", "meaning": "m"}))) == []


def test_errors_come_all_and_in_order(spark):
    made = body(article(title="", url="ftp://x"), schema_version=2)
    got = I.validate(spark.createDataFrame([("k", json.dumps(made)), ("ok", json.dumps(body()))], "k string, b string"), "k", "b").orderBy("ordinal").collect()
    assert [r.path for r in got] == ["schema_version", "articles[0].title", "articles[0].url"]
