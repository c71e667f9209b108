"""Passages that repeat a short phrase are found like any other."""

import random

from pressmill.llm import leaks as L
from test_leaks import brute


def test_repetitive_passages():
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    phrases = [[word() for _ in range(n)] for n in (1, 2, 3, 5) for _ in range(25)]
    items = [(i, " ".join((p * 18)[:18])) for i, p in enumerate(phrases)]
    docs = []
    for k in range(1500):
        text = [word() for _ in range(r.randrange(7, 60))]
        at = r.randrange(len(text))
        text[at:at] = items[k % len(items)][1].split()
        docs.append((k, " ".join(text)))
    got = L.PassageIndex(items, 18, 5, 1e-6).search([t for _, t in docs])
    assert {(k, i) for k, i, _ in got} == brute(docs, items)
