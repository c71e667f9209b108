"""Votes of chunks and the whole cascade of quality gates over all documents."""

import math
import random

import pytest

import __spark_entry__ as entry
from pressmill.llm import langid as L
from test_langid import sentence


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    return L.fit([(lang, " ".join(sentence(r, lang) for _ in range(4))) for lang in L.LANGUAGES for _ in range(40)])


def test_votes(model):
    r = random.Random(5)
    english, german = (" ".join(sentence(r, lang) for _ in range(12)) for lang in ("english", "german"))
    languages, score, margin, per_letter, agreement = model.vote(english)
    assert languages[0] == "english" and len(languages) == 5 and math.isfinite(score) and margin > 0 and per_letter >= 0.02 and agreement == 1.0
    assert model.vote(f"{english}\n{german}")[4] < 0.8
    assert math.isnan(model.vote("ЖЖЖ 123")[1]) and model.vote(None)[0] == []


def test_every_document_and_model_gates(spark, folder):
    whole = entry.queries()["page_quality_gates"](spark, folder).toPandas().set_index("doc_id")
    short = entry.queries()["quality_gates"](spark, folder).toPandas().set_index("doc_id").loc[whole.index]
    assert len(whole) == len(short) and whole.index.is_unique
    stopped = short["status"] != "usable"
    assert (whole["status"][stopped] == short["status"][stopped]).all()
    assert set(whole["status"]) & {"chunks disagree", "low margin", "html and model disagree"}
