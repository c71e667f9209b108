"""Leaks against a brute-force search of every passage."""

import random

import numpy as np
import pytest

from pressmill.llm import leaks as L


def brute(docs, items, passage=18):
    known = {}
    for key, text in items:
        w = L.words_of(text or "")
        for i in range(len(w) - passage + 1):
            known.setdefault(tuple(w[i : i + passage]), set()).add(key)
    out = set()
    for k, text in docs:
        w = L.words_of(text or "")
        for i in range(len(w) - passage + 1):
            out |= {(k, item) for item in known.get(tuple(w[i : i + passage]), ())}
    return out


def world(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "Порт", "Й", "STRASSE"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, words(r.choice([5, 17, 18, 19, 40, 80]))) for i in range(25)]
    docs = []
    for k in range(n):
        text = words(r.choice([0, 3, 17, 18, 35, 36, 37, 100, 400]))
        for _ in range(r.randrange(3)):
            source = r.choice(items)[1]
            size = r.choice([16, 17, 18, 19, 25])
            if len(source) >= size:
                at = r.randrange(len(source) - size + 1)
                put = r.randrange(len(text) + 1)
                text[put:put] = source[at : at + size]
        joined = "".join(w + r.choice([" ", "  ", ", ", "\n", "…", " ​"]) for w in text)
        docs.append((k, joined.upper() if k % 5 == 0 else joined))
    return docs, [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_exactly_the_leaks(seed):
    docs, items = world(seed)
    index = L.PassageIndex(items, 18, 5, 1e-6)
    got = {(docs[i][0], item) for i, item, _ in index.search([t for _, t in docs], block_words=500)}
    assert got == brute(docs, items) and got


def test_words_ignore_what_the_rule_ignores():
    assert L.words_of("Ｃafé­-NAÏVE ﬁn_42!") == ["cafe", "naive", "fin", "42"]
    assert L.words_of("É") == L.words_of("e") and L.words_of("zero​width") == ["zerowidth"]


def test_minimum_hash_draws_follow_the_bound():
    index = L.PassageIndex([(1, "a " * 40)], 18, 5, 1e-6)
    for bound, draws in zip(index.bounds, index.draws, strict=True):
        assert bound == index.inside or (1 - index.inside / bound) ** draws <= 1e-6


def test_recall_without_verification_rests_on_the_draws():
    """The candidates alone hold every true pair: nothing but min-hashes brings them."""
    docs, items = world(99, 60)
    index = L.PassageIndex(items, 18, 5, 1e-6)
    index.exact = {g: v for g, v in index.exact.items()}
    small, starts, ends, owner, at = [], [], [], [], 0
    for k, (_, text) in enumerate(docs):
        w = L.words_of(text)
        if len(w) < 18:
            continue
        g = L._grams(L._hashes(w), 5)
        s = np.arange(0, max(1, len(w) - 17), 18)
        small.append(g)
        starts.append(s + at)
        ends.append(np.minimum(s + 32, len(g)) + at)
        owner.append(np.full(len(s), k))
        at += len(g)
    pairs = {tuple(p) for p in index.candidates(np.concatenate(small), np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)).tolist()}
    assert brute(docs, items) <= {(docs[k][0], item) for k, item in pairs}


def test_frame_blocks_and_edges(spark):
    docs, items = world(3, 80)
    want = brute(docs, items)
    df = spark.createDataFrame([(k, t, "x") for k, t in docs] + [(900, None, "x"), (901, "", "x"), (902, "a" * 500_000, "x"), (903, items[4][1] + " tail" * 60_000, "x")], "doc_id bigint, text string, item_id string")
    ask = spark.createDataFrame([*items, (500, None), (None, "x " * 50)], "item_id bigint, text string")
    for block in (4_000_000, 400):
        got = L.find_leaks(df, ask, "doc_id", "text", "item_id", "text", block_bytes=block).collect()
        pairs = [(r[0], r[1]) for r in got if r[0] < 900]
        assert sorted(pairs) == sorted(want)
    assert L.find_leaks(df.limit(0), ask, "doc_id", "text", "item_id", "text").count() == 0
    assert L.find_leaks(df, ask.limit(0), "doc_id", "text", "item_id", "text").count() == 0
