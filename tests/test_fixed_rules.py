"""Rules with fixed values, by cases that tell them from their neighbours."""

from pyspark.sql import functions as F

from pressmill.functions import html as H
from pressmill.functions import text as T
from pressmill.operators import archive as A
from pressmill.operators import evidence as E
from pressmill.operators import imports
from pressmill.operators import series as S

import pytest


def test_nine_is_no_alert_and_ten_is(spark):
    rows = [("t", f"{k:02d}", 3.0, 3) for k in range(7)]
    for last in (9, 10):
        df = spark.createDataFrame([*rows, ("t", "07", 40.0, last)], "topic string, bin string, v double, n int")
        got = S.trailing_baseline(df, "v", "n").where("bin = '07'").first()
        assert got.candidate == (last == 10) and got.threshold == 6.0 and abs(got.fold - 40 / 3) < 1e-9


def test_raw_counts_need_ten_above_the_mean(spark):
    rows = [("t", f"{k:02d}", 4.0, 4) for k in range(7)]
    for last, want in ((14, False), (15, True)):
        df = spark.createDataFrame([*rows, ("t", "07", float(last), last)], "topic string, bin string, v double, n int")
        assert S.trailing_baseline(df, "v", "n", 10.0).where("bin = '07'").first().candidate == want


def test_shares_choose_first_and_counts_only_where_nothing_is_verified(spark):
    schema = "topic string, bin string, n int, ratio double, candidate boolean"
    shares = spark.createDataFrame([("a", "1", 20, 1.5, True), ("a", "2", 20, 1.5, True), ("a", "3", 9, 9.0, False)], schema)
    raw = spark.createDataFrame([("a", "4", 90, 5.0, True), ("b", "5", 50, 2.0, True), ("c", "6", 50, 7.0, False)], schema)
    chosen = lambda v: {(r.topic, r.bin, r.basis) for r in S.chosen_alert(shares, raw, v).collect()}
    assert chosen(True) == {("a", "1", "share")} and chosen(False) == {("a", "1", "share"), ("b", "5", "raw count only")}


def test_norms_and_requests(spark):
    points = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("a", "2", 5), ("b", "2", 6), ("a", "3", 7)], "topic string, bin string, norm int")
    assert [tuple(r) for r in S.norm_failures(points).collect()] == [("2", 5, 6)]
    expected = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    saved = spark.createDataFrame([("x", 200), ("y", 429), ("y", 429)], "k string, status int")
    assert {tuple(r) for r in S.collected(expected, saved, "k").collect()} == {("x", "200"), ("y", "429"), ("z", "not collected")}


def test_an_unknown_language_beside_a_known_one_is_ambiguous(spark):
    rows = [("d1", "b1", "r2", None), ("d1", "b1", "r1", "eng"), ("d2", "b1", "r3", None), ("d3", "b1", "r4", "eng"), ("d3", "b2", "r5", "spa"), ("d4", "b1", "r6", "eng"), ("d4", "b1", "r7", "spa")]
    df = spark.createDataFrame(rows, "doc string, batch string, record_id string, language string")
    got = {r.doc: (r.record_id, r.language, r.language_status) for r in A.deduplicate_as_of(df, ["doc"]).collect()}
    assert got == {"d1": ("r1", None, "ambiguous_first_batch"), "d2": ("r3", None, "single"), "d3": ("r4", "eng", "single"), "d4": ("r6", None, "ambiguous_first_batch")}


def test_the_future_cannot_be_asked_for(spark):
    docs = spark.createDataFrame([("eng", "2", "x")], "language string, bin string, topic string")
    expected = spark.createDataFrame([("eng", "2")], "language string, bin string")
    assert A.observed_share(docs, expected, "x", as_of="2").count() == 1
    with pytest.raises(ValueError):
        A.observed_share(docs, expected, "x", as_of="1")


def test_as_of_rows_and_lookups_that_must_match(spark):
    probes = spark.createDataFrame([("u", "2"), ("u", "1"), ("u", "2"), ("w", "9")], "k string, b string")
    seen = spark.createDataFrame([("u", "1", "p"), ("u", "2", "q"), ("u", "3", "r")], "k string, b string, v string")
    got = {(r.k, r.b): [x.value for x in r.as_of_rows] for r in A.asof_rows(probes, seen, "k", "b", "v").collect()}
    assert got == {("u", "1"): ["p"], ("u", "2"): ["p", "q"], ("w", "9"): []}
    table = spark.createDataFrame([("u", 1), ("w", 2), ("x", 3), ("x", 4)], "k string, n int")
    assert A.must_match(probes, table, "k").count() == 4
    for bad in ("missing", "x"):
        with pytest.raises(Exception, match="no single entry"):
            A.must_match(spark.createDataFrame([(bad,)], "k string"), table, "k").collect()


def test_credentials_and_paths(spark):
    cases = [("gho" + "_" + "a" * 30, ["service token"]), ("gho" + "_" + "a" * 29, []), ("github" + "_pat_" + "a_" * 10, ["fine-grained token"]), ("name@mail.example", []), ("AKIA" + "A1" * 8, ["access key"]), ("-----BEGIN " + "PRIVATE KEY-----", ["private key"])]
    df = spark.createDataFrame(cases, "t string, want array<string>")
    assert all(r.want == r.got for r in df.select("want", T.secret_kinds(F.col("t")).alias("got")).collect())
    paths = [("cache/a", 1, "forbidden path"), ("a/cache/b", 1, None), ("a/.env.local", 1, "forbidden path"), ("a/Backup2", 1, "forbidden path"), ("a.zip", 1, "forbidden path"), ("a.txt", 2_000_001, "too large"), ("a.txt", 2_000_000, None)]
    df = spark.createDataFrame(paths, "p string, n bigint, want string")
    assert all(r.want == r.got for r in df.select("want", T.path_issue(F.col("p"), F.col("n")).alias("got")).collect())


def test_error_titles(spark):
    titles = [("Forbidden harbour", False), ("Ship not found", False), ("Page Not Found", True), ("Seite nicht gefunden | x", True), ("PÁGINA no encontrada", True), ("Page introuvable", True)]
    df = spark.createDataFrame([(t, "The harbour was closed for a day. " * 30, w) for t, w in titles], "t string, x string, w boolean")
    got = df.select("w", (T.quality_status(F.lit(True), F.col("t"), F.col("x")) == "error title").alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_paragraphs_end(spark):
    assert H.body_text("<article><p>One.</p><div>aside</div><p>Two <b>bold</b><p>Three</article><footer>All rights reserved</footer>") == "One.\nTwo bold\nThree"


def test_column_rules_are_the_body_rules(spark):
    claim = "struct<value:string,precision:string>"
    schema = f"record_id bigint, investigation_id string, id string, title string, publisher string, language string, url string, relevance string, duplicate_group string, duplicate_status string, claimed_timestamp {claim}, excerpt string, include_in_replay boolean"
    good = (1, "c", "abc", "t", "p", "english", "https://a.example/x", "related", None, None, None, None, False)
    change = {2: (None, "id"), 6: ("https://user:pw@host/x", "url"), 10: (("2024-02-31", "date"), "date_value")}
    rows = [good]
    for at, (value, _) in change.items():
        rows.append((at + 100, f"c{at}", *(value if k == at else v for k, v in enumerate(good) if k > 1)))
    for k, v in enumerate(("2024-13-45T99:99Z", "2024-02-31T10:00Z", "2024-02-28T10:00", "2024-02-28T10:00Z")):
        rows.append((200 + k, f"d{k}", *((v, "datetime") if j == 10 else x for j, x in enumerate(good) if j > 1)))
    got = {(r.record_id, r.rule) for r in imports.column_errors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(at + 100, rule) for at, (_, rule) in change.items()} | {(200 + k, "datetime_value") for k in range(3)}


def test_exactly_one(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, r string")
    assert [tuple(x) for x in E.single(rows.where("n = 1"), "context").collect()] == [(1, "a")]
    for bad in (rows, rows.where("n > 2")):
        with pytest.raises(Exception, match="expected one context"):
            E.single(bad, "context").collect()
