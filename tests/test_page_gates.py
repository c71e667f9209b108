"""The gates of the cascade, every one by itself and in its order; saved bytes."""

import gzip
import math

from pyspark.sql import functions as F

from pressmill.functions import html as H
from pressmill.functions import text as T

GOOD = dict(fetched=True, content_type="text/html; charset=utf-8", decoded=True, title="A strike", home=False, text="The harbour was closed for a day. " * 30, article=True, score=-900.0, margin=80.0, per_letter=0.1, agreement=1.0, html=False)
GATES = [
    ("not fetched", {"fetched": False}), ("content type", {"content_type": "application/pdf"}), ("content type", {"content_type": None}), ("not decoded", {"decoded": False}), ("error title", {"title": "Error 404"}), ("home page redirect", {"home": True}),
    ("no body", {"text": None}), ("short", {"text": "Too short."}), ("no structure", {"text": "word " * 300}), ("no article mark", {"article": False}), ("broken characters", {"text": GOOD["text"] + "�" * 9}),
    ("score not finite", {"score": math.nan}), ("score not finite", {"margin": None}), ("chunks disagree", {"agreement": 0.79}), ("low margin", {"per_letter": 0.019}), ("html and model disagree", {"html": True}), ("usable", {}),
]


def test_each_gate_and_their_order(spark):
    schema = "fetched boolean, content_type string, decoded boolean, title string, home boolean, text string, article boolean, score double, margin double, per_letter double, agreement double, html boolean"
    rows, worst = [], dict(GOOD)
    for _, change in GATES:
        rows.append(tuple((GOOD | change).values()))
    # a page that fails a gate and all after it stops at the first
    late = [(name, change) for name, change in GATES if change and "text" not in change]
    for _, change in reversed(late):
        worst |= change
        rows.append(tuple(worst.values()))
    df = spark.createDataFrame(rows, schema)
    read = T.quality_status(F.col("fetched"), F.col("title"), F.col("text"))
    rest = ("content_type", "decoded", "home", "article", "score", "margin", "per_letter", "agreement", "html")
    got = [r[0] for r in df.select(T.page_status(read, *[F.col(c) for c in rest])).collect()]
    assert got == [name for name, _ in GATES] + [name for name, _ in reversed(late)]


def test_saved_bytes():
    page = "<p>página</p>".encode()
    assert H.decode(page, None) == "<p>página</p>" == H.decode(gzip.compress(page), "GZIP")
    assert H.decode(page, "gzip") is None and H.decode(gzip.compress(page)[:-9], "gzip") is None and H.decode(gzip.compress(b"x" * 100), "gzip", 99) is None
