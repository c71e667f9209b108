"""Page furniture is counted over all pages and whole texts, by a share of them."""

import random

from pressmill.llm import langid as L
from test_langid import sentence

LINE = "Les articles sont dans la langue de leur agence"


def test_lines_beyond_the_sample_and_its_characters(spark):
    r = random.Random(7)
    rows = [(i, lang, sentence(r, lang)) for i, lang in enumerate(L.LANGUAGES * 200)]
    # on six of 1,200 pages, behind the characters that the fitting reads
    rows[::200] = [(k, lang, f"{text} {text}\r\n\u00a0{LINE} \n") for k, lang, text in rows[::200]]
    df = spark.createDataFrame(rows, "k int, lang string, text string")
    model = L.fit_from(df, "k", "text", "lang", per_language=20, chars_per_text=90)
    assert model.furniture == {LINE}
    assert model.texts([sentence(r, "english") + "\n" + LINE])[0][0] == ["english"]


def test_share_of_pages(spark):
    df = spark.createDataFrame([(f"page {i}\nseldom\nseldom" if i < 4 else f"page {i}\noften" if i < 20 else None,) for i in range(1000)], "text string")
    assert L.recurring_lines(df, "text", share=0.005) == {"often"} and L.recurring_lines(df, "text") == {"often", "seldom"}
    assert L.recurring_lines(df.limit(0), "text") == frozenset()
