"""Shares of every language and day, by what the table holds."""

import pandas as pd

import __spark_entry__ as entry
from pressmill.operators import archive as A


def timeline(spark, tmp_path, rows):
    columns = ["record_id", "id", "url", "language", "gdelt_seendate", "publisher"]
    pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / "timeline_data.parquet")
    return str(tmp_path)


def test_every_language_and_day(spark, tmp_path):
    folder = timeline(spark, tmp_path, [
        ("1", "a", "https://a.example/energy/1", "Spanish", "20250629T101500Z", "p"), ("2", "b", "https://a.example/rail/2", "es-419", "20250629T111500Z", "p"), ("3", "c", "https://a.example/energy/3", "Turkish ", "20250701T101500Z", "p"),
        ("4", "d", "https://a.example/energy/4", "eng", "20260702T101500Z", "p"), ("5", "e", "https://a.example/energy/5", "unk", "20250630T101500Z", "p"), ("6", "f", "https://a.example/energy/6", None, None, "p"),
    ])
    rows = entry.queries()["archive_language_share_all"](spark, folder).collect()
    got = {(r.language, r.bin): (r.status, r.n_all, r.share) for r in rows}
    assert len(rows) == len(got) == 3 * 369 and {k[0] for k in got} == {"english", "spanish", "turkish"}
    assert got[("spanish", "20250629")] == ("observed", 2, 0.5) and got[("turkish", "20250701")] == ("observed", 1, 1.0) and got[("english", "20260702")] == ("observed", 1, 1.0)
    assert got[("english", "20250630")][0] == "no_usable_language_exposure" and got[("english", "20250702")][0] == "missing_bin"


def test_no_document_is_lost(spark, folder):
    rows = entry.queries()["archive_language_share_all"](spark, folder).toPandas()
    three = entry.queries()["archive_language_share"](spark, folder).toPandas()
    assert rows["n_all"].sum() > three["n_all"].sum() and set(rows["language"]) >= {"english", "german", "russian", "spanish", "french", "chinese"}


def test_unknown_topics_leave_no_share(spark, tmp_path):
    folder = timeline(spark, tmp_path, [
        ("1", "a", "https://a.example/energy/1", "en", "20250629T101500Z", "p"), ("2", "b", "https://b.example/", "en", "20250629T111500Z", "p"), ("3", "c", "https://a.example/energy/3", "en", "20250630T101500Z", "p"),
    ])
    got = {r.bin: (r.status, r.n_topic, r.n_all, r.share) for r in entry.queries()["archive_language_share_all"](spark, folder).collect()}
    assert got["20250629"] == ("topic_membership_unverified", None, 2, None) and got["20250630"] == ("observed", 1, 1, 1.0)


def test_unknown_topics_of_the_operator(spark):
    docs = spark.createDataFrame([("eng", "b1", "x"), ("eng", "b1", None), ("spa", "b1", "x"), (None, "b1", None)], "language string, bin string, topic string")
    expected = spark.createDataFrame([("eng", "b1"), ("spa", "b1")], "language string, bin string")
    got = {r.language: (r.status, r.n_topic, r.n_all, r.share) for r in A.observed_share(docs, expected, "x").collect()}
    assert got == {"eng": ("topic_membership_unverified", None, 2, None), "spa": ("observed", 1, 1, 1.0)}
