"""As-of rules, samples, scans, streams, store and API."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pressmill import api
from pressmill.operators import archive as A
from pressmill.operators import evidence as E
from pressmill.operators import sampling
from pressmill.sources import files, sinks
from pressmill.store import Forbidden, ImportRefused, NotFound, Store
from pressmill.streaming import flows


def observations(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, document_id string, batch string, language string")


def test_asof_dedup_ignores_the_future_and_nulls_conflicts(spark):
    rows = [(3, "a", "01", "x"), (2, "a", "01", "y"), (1, "a", "02", "x"), (5, "b", "01", "x"), (4, "b", "01", "x"), (9, "c", "03", None), (8, "d", None, "x")]
    got = {r.document_id: (r.batch, r.record_id, r.language) for r in A.deduplicate_as_of(observations(spark, rows), ["document_id"], "02").collect()}
    assert got == {"a": ("01", 2, None), "b": ("01", 4, "x")}
    later = [*rows, (0, "a", "03", "z")]
    again = {r.document_id: (r.batch, r.record_id, r.language) for r in A.deduplicate_as_of(observations(spark, later), ["document_id"], "02").collect()}
    assert again == got


def test_shares(spark):
    docs = spark.createDataFrame([("eng", "b1", "x"), ("eng", "b1", "y"), ("spa", "b1", "x"), (None, "b2", "x")], "language string, bin string, topic string")
    expected = spark.createDataFrame([(lang, b) for lang in ("eng", "spa") for b in ("b1", "b2", "b3")], "language string, bin string")
    got = {(r.language, r.bin): (r.status, r.share) for r in A.observed_share(docs, expected, "x").collect()}
    assert got[("eng", "b1")] == ("observed", 0.5) and got[("spa", "b1")] == ("observed", 1.0)
    assert got[("eng", "b2")] == ("no_usable_language_exposure", None) and got[("eng", "b3")] == ("missing_bin", None)


def test_valid_stamp(spark):
    rows = spark.createDataFrame([("20260101001500",), ("20260101001600",), ("20260101001501",), ("20260230000000",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(A.valid_stamp(F.col("v"))).collect()] == [True, False, False, False, False, False]


def greedy(rows, seed, quotas, cap):
    import hashlib

    seen, hosts, out = set(), {}, []
    for name, quota in quotas.items():
        mine = sorted((hashlib.sha256(f"{seed}|{u}".encode()).hexdigest(), rec, u, h) for rec, s, u, h in rows if s == name)
        n = 0
        for _, rec, u, h in mine:
            if n >= quota:
                break
            if u in seen or hosts.get(h, 0) >= cap:
                continue
            seen.add(u)
            hosts[h] = hosts.get(h, 0) + 1
            n += 1
            out.append(rec)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_sample_is_the_sequential_one(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abc"), f"https://h{r.randrange(9)}.example/{r.randrange(40)}") for i in range(300)]
    rows = [(i, s, u, u.split("/")[2]) for i, s, u in rows]
    quotas = {"b": 7, "a": 5, "c": 5}
    df = spark.createDataFrame(rows, "record_id bigint, s string, u string, h string").withColumn("identity", F.col("u"))
    got = [x.record_id for x in sampling.greedy_sample(df, "s", "u", "h", "identity", "z", quotas).orderBy("sample_id").collect()]
    want = greedy(rows, "z", quotas, 2)
    urls = {i: u for i, _, u, _ in rows}
    assert [urls[i] for i in got] == [urls[i] for i in want]


def cards(spark):
    rows = [(1, "c", "a", "T", "related", True, None, "same", True), (2, "c", "b", "T", "related", True, "possible", "other", True), (3, "c", "d", "T", "unrelated", True, None, "same", False),
            (4, "c", "e", "T", "uncertain", False, None, None, False), (5, "c", "f", "T", None, True, None, "  ", None)]
    return E.cards(spark.createDataFrame(rows, "record_id bigint, investigation_id string, id string, title string, relevance string, inspected boolean, duplicate_status string, excerpt string, include_in_replay boolean"))


def test_counts_agree_with_filter_and_fold(spark):
    rows = cards(spark).cache()
    for r in E.counts_matrix(rows).collect():
        kept = E.fold(E.eligible(rows, r.unrelated, r.possible, r.inventory))
        folded = kept.where("folded").count() if r.fold else 0
        assert (r.n_visible, r.n_folded) == (kept.count() - folded, folded)
        assert r.n_visible + r.n_folded + r.n_filtered == r.n_cohort


def test_scans(spark, tmp_path):
    good = "\t".join(["a"] * 3).encode()
    (tmp_path / "x.csv").write_bytes(good + b"\r\n" + b"a\tb\n" + b"a\t\xff\tc\n" + good)
    rows = files.tsv_lines(spark, str(tmp_path / "x.csv"), 3).orderBy("row_number").collect()
    assert [r.status for r in rows] == ["ok", "wrong_shape", "bad_utf8", "ok"] and [r.row_number for r in rows] == [1, 2, 3, 4]
    assert files.tsv_lines(spark, str(tmp_path / "x.csv"), 3, "replace").where("status = 'ok'").count() == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m1", "l1\nl2\n")
        z.writestr("m2", "l3")
    assert [(r.member, r.row_number, r.line) for r in files.zip_lines(spark, str(tmp_path / "z.zip")).orderBy("member", "row_number").collect()] == [("m1", 1, "l1"), ("m1", 2, "l2"), ("m2", 1, "l3")]
    with pytest.raises(Exception, match="expands beyond"):
        files.zip_lines(spark, str(tmp_path / "z.zip"), 3).count()
    (tmp_path / "m.txt").write_text("12 abc http://x/20260101000000.gkg.csv\nbad line\n 7 d http://x/none\n")
    assert [(r.bytes, r.batch) for r in files.manifest(spark, str(tmp_path / "m.txt")).orderBy("bytes").collect()] == [(7, None), (12, "20260101000000")]
    (tmp_path / "l.xml").write_text("<R><Contents><Key>k</Key><Size>3</Size></Contents></R>")
    assert files.listing(spark, str(tmp_path / "l.xml")).first().Key == "k"
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_documents(spark, str(tmp_path / "d.json"), "a int").select("sha256").distinct().count() == 1
    (tmp_path / "p.txt").write_text("one\r\ntwo")
    assert [(r.number, r.line) for r in files.text_pages(spark, str(tmp_path / "p.txt")).orderBy("number").collect()] == [(1, "one"), (2, "two")]


def test_records_of_several_lines(spark):
    head = "20260101000000-T{}" + "\t" * 26
    lines = [head.format(1) + "a", "", "more", head.format(2) + "b"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "f string, n int, t string")
    out = {r.record: r for r in files.reassemble(df, "f", "n", "t", files.is_record_start(F.col("t"))).collect()}
    assert [out[1].continuations, out[2].continuations] == [2, 0] and out[1].content.endswith("a\n\nmore")
    bad = spark.createDataFrame([("f", 0, "stray"), ("f", 1, head.format(1)), ("f", 2, "x\ty")], "f string, n int, t string")
    assert all(r.broken for r in files.reassemble(bad, "f", "n", "t", files.is_record_start(F.col("t"))).collect())


def test_newest_response(spark):
    import hashlib

    meta = spark.createDataFrame([("k", 1, 200, "x", "f1"), ("k", 2, 429, hashlib.sha256(b"b").hexdigest(), "f2")], "cache_key string, attempt int, status int, sha256 string, file string")
    bodies = spark.createDataFrame([("f1", bytearray(b"a")), ("f2", bytearray(b"b"))], "file string, content binary")
    r = files.newest_responses(meta, bodies).first()
    assert (r.status, r.intact) == (429, True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=x|y", 1)], "a string, b int")
    sinks.write_csv(df, str(tmp_path / "c"), ["b", "a"], one_file=True)
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines() == ["b,a", "1,'=x|y"]
    sinks.write_pretty_json(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"a": "=x|y", "b": 1}]
    assert "=x\\|y" in sinks.pipe_table(df, ["a", "b"])
    sinks.write_json_lines(df, str(tmp_path / "l"))
    assert files.json_lines(spark, str(tmp_path / "l"), "a string, b int").count() == 1


def write_batches(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    return str(tmp_path / "b*")


def test_stream_equals_batch_counters(spark, tmp_path):
    from pressmill.operators import counters as C

    day = 86400
    batches = [[("a", 5, 1, 0, "p"), ("b", 6, 2, 0, "p")], [("a", 3, 3, 2 * day, "q"), ("a", 5, 1, 0, "p")], [("c", 9 * day * 10**6, 4, 0, "p")]]
    schema = "id string, intake bigint, rec bigint, ev bigint, pub string"
    path = write_batches(spark, tmp_path, batches, schema)
    stream = flows.files_stream(spark, path, schema)
    to_first = lambda df: C.first_deliveries(df, F.col("id"), F.col("intake"), F.col("rec"), F.col("ev"), F.col("pub"), 72)
    got = {(r.day, r.key): r.n for r in flows.corrected_counts(stream, to_first).collect()}
    whole = to_first(spark.createDataFrame([r for b in batches for r in b], schema))
    assert got == {(r.day, r.key): r.n for r in C.totals(C.begin(whole).counters).collect()} == {(2, "q"): 1, (0, "p"): 1}


def test_stream_keeps_first_and_alerts(spark, tmp_path):
    schema = "topic string, number bigint, n bigint"
    path = write_batches(spark, tmp_path, [[("t", i, 10) for i in range(5)], [("t", 5, 10), ("t", 6, 10), ("t", 7, 25)], [("t", 9, 99), ("t", 3, 1)]], schema)
    rows = {r.number: r for r in flows.run_to_end(flows.running_baseline(flows.files_stream(spark, path, schema)), "alerts").collect()}
    assert rows[7].candidate and rows[7].threshold == 20.0 and rows[6].threshold is None
    assert rows[9].threshold is None  # the gap at 8 starts the baseline anew
    schema = "ts timestamp, k string"
    from datetime import datetime

    path = write_batches(spark, tmp_path / "k", [[(datetime(2026, 1, 1), "a")], [(datetime(2026, 1, 1, 0, 5), "a"), (datetime(2026, 1, 1, 0, 6), "b")]], schema)
    assert flows.run_to_end(flows.keep_first(flows.files_stream(spark, path, schema), "ts", ["k"], "1 hour"), "first").count() == 2


def sample_body(name="col-1"):
    base = {"publisher": "P", "language": "english"}
    return json.dumps({
        "schema_version": 1, "id": name, "title": "T", "topic": "t",
        "articles": [
            {"id": "art-1", "title": "A", "relevance": "related", "include_in_replay": True, "claimed_timestamp": {"value": "2030-01-02", "precision": "date"}, **base},
            {"id": "art-2", "title": "B", "relevance": "related", "include_in_replay": True, "claimed_timestamp": {"value": "2030-01-03T08:00:00+00:00", "precision": "datetime"}, **base},
            {"id": "art-3", "title": "C", "relevance": "unrelated", "duplicate_group": "G", "duplicate_status": "confirmed", **base},
            {"id": "art-4", "title": "D", "relevance": "unrelated", "duplicate_group": "G", "duplicate_status": "confirmed", **base},
            {"id": "art-5", "title": "E", "relevance": "uncertain", "inspected": False, **base},
        ],
        "uncertainties": [{"id": "note-1", "title": "t", "detail": "d", "source_ids": ["art-1", "art-2"]}],
    })


def test_store_and_api(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"bundled-1": sample_body("bundled-1")})
    assert api.import_collection(store, sample_body()) == "col-1"
    with pytest.raises(ImportRefused):
        api.import_collection(store, sample_body())
    with pytest.raises(ImportRefused):
        api.import_collection(store, sample_body("bundled-1"))
    (tmp_path / "s" / "broken.json").write_text("{")
    assert [r.id for r in api.list_collections(store).collect()] == ["bundled-1", "col-1"]
    assert store.errors().select("file").distinct().count() == 1
    assert api.evidence(store, "col-1").count() == 4 and api.evidence(store, "col-1", inventory=True).count() == 5
    assert api.evidence(store, "col-1", unrelated=False).count() == 2 and api.evidence(store, "col-1", fold=True).count() == 3
    assert api.evidence_counts(store, "col-1").count() == 16
    assert [(r.day, r.claim_label) for r in api.timeline(store, "col-1").collect()] == [("2030-01-02", "2030-01-02 (day only)"), ("2030-01-03", "2030-01-03 08:00 UTC")]
    assert api.timeline(store, "col-1", "2030-01-03").count() == 1
    with pytest.raises(NotFound):
        api.timeline(store, "col-1", "2031-01-01")
    detail = api.source_detail(store, "col-1", "art-3").first()
    assert detail.copies == ["art-4"] and api.source_detail(store, "col-1", "art-1").first().notes == ["note-1"]
    with pytest.raises(NotFound):
        api.source_detail(store, "col-1", "ghost")
    with pytest.raises(Forbidden):
        api.delete_collection(store, "bundled-1")
    api.delete_collection(store, "col-1")
    with pytest.raises(NotFound):
        api.delete_collection(store, "col-1")
    assert api.flag(None, True) and not api.flag("0", True)
    with pytest.raises(ValueError):
        api.flag("yes", True)
    assert json.loads(api.import_template())["schema_version"] == 1
