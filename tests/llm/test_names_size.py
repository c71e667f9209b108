"""The near join of names: it shuffles names and no pairs, and leaving pairs out early loses no link."""

import itertools
import random

import numpy as np

from pressmill.llm import names as N
from test_names import ALIKE, APART, corpus


def shuffled(spark):
    """Bytes that the application has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_near_names_shuffle_no_pairs(spark):
    r = random.Random(4)
    # nearly all pairs have n-grams in common
    cores = sorted({"".join(r.choice("abdeiou") for _ in range(9)) + ":0:0:1" for _ in range(800)})
    df = N.materialize(spark.createDataFrame([(c,) for c in cores], "core string"), "cores")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        assert N.near_names(df, 0.2).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled(spark) - before < 4_000 * len(cores)


def cores_of(names):
    """Cores of names, as counted over all of them."""
    words = [N.words_of(n) for n in names]
    count = {}
    for ws in words:
        for t in {w[0] for w in ws}:
            count[t] = count.get(t, 0) + 1
    return sorted({" ".join(f"{t}:{int(m)}:{int(c)}:{count[t]}" for t, m, c in ws) for ws in words if ws})


def test_pairs_left_out_early_have_no_likeness():
    odd = ["Vakudolan EH", "Vakudolan Energy Herald", "WJ Lagos", "Weekly Journal Lagos", "a b " * 20, "Q. R. S. Abernathy", "Ж Газета", "Газета Ж.", "Kathrine Abernathy", "Katy Abernathy"]
    names = [*corpus(places=15)[0], *(n for pair in ALIKE + APART for n in pair if n), *odd]
    cores = cores_of(names)
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(cores)), 2), strict=True))
    for hints in (N.HINTS, {}):
        known = N._Words(cores, hints)
        may = N._may_mean_one(known, i, known, j)
        read = [N._parsed(c) for c in cores]
        alike = np.array([N.likeness(read[x], read[y], hints) > 0 for x, y in zip(i, j, strict=True)])
        assert alike.any() and not (alike & ~may).any() and may.sum() < 0.1 * len(may)


def test_blocks_and_bounds_change_nothing():
    r = np.random.default_rng(2)
    dense = r.random((40, 30)) * (r.random((40, 30)) < 0.3)
    side = (np.concatenate([[0], np.cumsum((dense > 0).sum(1))]), np.nonzero(dense)[1], dense[dense > 0])
    want = {(x, y) for x, y in zip(*np.nonzero(dense @ dense.T >= 0.8), strict=True)}
    for cells, products in ((1 << 20, 1 << 21), (90, 7), (1, 1)):
        got = [(x, y, c) for found in N._cosines(side, side, 0.8, cells, products) for x, y, c in zip(*found, strict=True)]
        assert {(x, y) for x, y, _ in got} == want and len(got) == len(want)
        assert np.allclose([c for *_, c in got], [dense[x] @ dense[y] for x, y, _ in got])
