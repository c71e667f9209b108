"""The set similarity join against comparison of all pairs."""

import random

import numpy as np
import pytest

from pressmill.llm import neardup as N


def words(text):
    return frozenset(N._WORD.findall(text.lower()))


def brute(rows, threshold):
    out = set()
    for i, (g, a, x) in enumerate(rows):
        for h, b, y in rows[i + 1 :]:
            if g == h and a != b and x and y and words(x) and words(y):
                s, t = words(x), words(y)
                if len(s & t) / len(s | t) >= threshold - 1e-12:
                    out.add((g, min(a, b), max(a, b)))
    return out


def world(seed, n=110, rare=300, common=12):
    """Texts of many frequent and some rare words, with edited copies, of all small sizes too."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and r.random() < 0.5:
            base = list(words(r.choice(rows)[2] or "x"))
            for _ in range(r.randrange(3)):
                base[r.randrange(len(base))] = f"new{r.randrange(50)}"
            if r.random() < 0.3:
                base += [f"add{r.randrange(30)}"]
        else:
            base = [f"c{r.randrange(common)}" for _ in range(r.randrange(1, 14))] + [f"r{r.randrange(rare)}" for _ in range(r.randrange(0, 5))]
        r.shuffle(base)
        rows.append((r.choice("gh"), f"id{k:03d}", " ".join(base)))
    return rows


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.9])
@pytest.mark.parametrize("limits", [(3_000, 30_000), (4, 12), (1, 3)])
@pytest.mark.parametrize("seed", range(3))
def test_signatures_are_complete(threshold, limits, seed):
    """Any two sets alike enough share a signature, the smaller one's being in the index."""
    rows = [words(t) for _, _, t in world(seed)]
    tokens, sizes = N.flat_word_sets([" ".join(sorted(s)) for s in rows])
    counts: dict = {}
    for t in tokens.tolist():
        counts[t] = counts.get(t, 0) + 1
    levels = np.asarray([N._level(counts[t]) for t in tokens.tolist()], np.uint8)
    row, keys, index = N.signatures(tokens, sizes, levels, threshold, limits)
    every, indexed = {}, {}
    for i, k, x in zip(row.tolist(), keys.tolist(), index.tolist(), strict=True):
        every.setdefault(i, set()).add(k)
        if x:
            indexed.setdefault(i, set()).add(k)
    for i, s in enumerate(rows):
        for j, t in enumerate(rows):
            if i != j and s != t and len(s) <= len(t) and len(s & t) / len(s | t) >= threshold:
                assert indexed.get(i, set()) & every.get(j, set()), (s, t)


@pytest.mark.parametrize("limits", [(3_000, 30_000), (40, 60), (5, 30), (1, 2)])
@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_signatures_of_long_sets_are_complete(threshold, limits):
    """Sets of 90 to 600 words, frequent ones among them, with copies at the edge of the threshold."""
    r = random.Random(8)
    rows = []
    for size in (90, 110, 127, 128, 129, 150, 200, 255, 257, 300, 520, 600):
        base = [f"w{k}" for k in r.sample(range(900), size)]
        rows.append(frozenset(base))
        for _ in range(2):
            gone = int(size * (1 - threshold) / (1 + threshold))
            rows.append(frozenset(base[gone:] + [f"n{r.randrange(10**6)}" for _ in range(r.randrange(gone + 1))]))
            rows.append(frozenset(r.sample(base, int(size * threshold) + 1)))
    tokens, sizes = N.flat_word_sets([" ".join(sorted(s)) for s in rows])
    counts: dict = {}
    for t in tokens.tolist():
        counts[t] = counts.get(t, 0) + 1
    levels = np.asarray([N._level(counts[t]) for t in tokens.tolist()], np.uint8)
    row, keys, index = N.signatures(tokens, sizes, levels, threshold, limits)
    every = [set() for _ in rows]
    indexed = [set() for _ in rows]
    for i, k, x in zip(row.tolist(), keys.tolist(), index.tolist(), strict=True):
        every[i].add(k)
        if x:
            indexed[i].add(k)
    pairs = 0
    for i, s in enumerate(rows):
        for j, t in enumerate(rows):
            if i != j and s != t and len(s) <= len(t) and len(s & t) / len(s | t) >= threshold:
                pairs += 1
                assert indexed[i] & every[j], (len(s), len(t))
    assert pairs > 10 and len(row) < 20_000 * len(rows)


@pytest.mark.parametrize("limits", [(3_000, 30_000), (3, 10)])
def test_frame_against_all_pairs(spark, limits):
    rows = world(11)
    rows += [("g", f"copy{k:03d}", "one hot text that everybody copied word by word") for k in range(60)]
    rows += [("h", "id000", "one hot text that everybody copied word by word"), ("g", "copy000", "one hot text that everybody copied word by WORD")]
    rows += [("g", "n1", None), ("g", "n2", ""), ("g", "n3", "!!!"), ("g", "long1", "x " + "longword" * 50_000), ("g", "long2", " ".join(f"v{i}" for i in range(60_000))), ("g", "long3", " ".join(f"v{i}" for i in range(60_100)))]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "g string, id string, text string, n int, tokens string").repartition(5)
    sets = N.word_sets(df, "g", "id", "text")
    got = N.member_pairs(sets, N.similar_classes(sets, "g", 0.75, sketch_bits=12, limits=limits), "g", "id").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, 0.75)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, id string, text string")
    sets = N.word_sets(df, "g", "id", "text")
    assert N.member_pairs(sets, N.similar_classes(sets, "g", 0.75, sketch_bits=10), "g", "id").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(a, a + 1) for a in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(7, 8)] * 3
    links = [(a, b) for a, b in links if a != b]
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {x.set_id: x.group_id for x in N.components(spark.createDataFrame(links, "set_a bigint, set_b bigint")).collect()}
    assert got == {x: top(x) for x in parent}
    assert N.components(spark.createDataFrame([], "set_a bigint, set_b bigint")).count() == 0


def test_grouped_records(spark):
    base = "one two three four five six seven eight"
    rows = [("g", "a", base), ("g", "b", base + " nine"), ("g", "c", base + " nine ten"), ("g", "d", "something else entirely here"), ("h", "a", base), ("g", "e", base.upper())]
    sets = N.word_sets(spark.createDataFrame(rows, "g string, id string, text string"), "g", "id", "text")
    got = {(r.g, r.id): (r.group_id, r.n_links) for r in N.grouped_records(sets, N.similar_classes(sets, "g", 0.8), "g", "id").collect()}
    assert got[("g", "a")] == got[("g", "e")] and got[("g", "a")][1] == 2
    assert len({got[("g", x)][0] for x in "abce"}) == 1 and got[("g", "d")][1] == got[("h", "a")][1] == 0
    assert got[("h", "a")][0] != got[("g", "a")][0]
