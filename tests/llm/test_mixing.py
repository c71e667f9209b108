"""Budgets, dependent rounding and the mix's token sums."""

import random

import pytest

from pressmill.llm import mixing as M

pytest.importorskip("tiktoken")


def test_budgets_fill_under_caps():
    b = M.budgets({"a": 100, "b": 100, "c": 10}, {"a": (0.4, 2), "b": (0.3, 2), "c": (0.3, 2)})
    assert b["c"] == 20 and sum(b.values()) == pytest.approx(210)
    assert b["a"] / b["b"] == pytest.approx(4 / 3)
    assert M.budgets({"a": 10}, {"a": (1.0, 1), "gone": (1.0, 5)}) == {"a": 10, "gone": 0}
    assert M.budgets({}, {"a": (1.0, 1)}) == {"a": 0.0}
    assert M.budgets({"a": 5}, {"a": (0.0, 1)}) == {"a": 0.0}


def run(records, seed):
    out, it = [], M.pivot(records, seed)
    while True:
        try:
            out.append(next(it))
        except StopIteration as end:
            return out, end.value


@pytest.mark.parametrize("seed", range(5))
def test_pivot_keeps_the_mass(seed):
    r = random.Random(seed)
    records = [(i, r.randrange(1, 50), r.random()) for i in range(400)]
    taken, left = run(records, seed)
    weight = {k: w for k, w, _ in records}
    mass = sum(weight[k] * x for k, x in taken) + (left[1] * left[2] if left else 0)
    assert mass == pytest.approx(sum(w * p for _, w, p in records))
    assert len(taken) + bool(left) == 400 and {x for _, x in taken} <= {0, 1}


def test_pivot_is_fair():
    """Over many seeds each record is taken about as often as its fraction says."""
    records = [(i, 1 + i % 5, 0.1 + 0.8 * (i % 7) / 6) for i in range(20)]
    hits = dict.fromkeys(range(20), 0.0)
    rounds = 3000
    for seed in range(rounds):
        taken, left = run(records, seed)
        for k, x in taken:
            hits[k] += x
        if left:
            hits[left[0]] += left[2]
    assert all(abs(hits[k] / rounds - p) < 0.04 for k, _, p in records)


def test_pivot_edges():
    assert run([], 1) == ([], None)
    assert run([(1, 0, 0.5), (2, 5, 0.0), (3, 5, 1.0)], 1) == ([(1, 0), (2, 0), (3, 1)], None)


def documents(spark, n=600):
    r = random.Random(2)
    rows = []
    for i in range(n):
        source = r.choice(["hot", "hot", "hot", "b", "small", None, "unlisted"])
        text = r.choice([None, "", *["word " * r.randrange(1, 200)] * 8])
        rows.append((i, text, source if source != "small" or i % 9 == 0 else "hot", "x", 3))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, fraction string, rate int").repartition(7)


def targets(spark):
    return spark.createDataFrame([("hot", 0.5, 1), ("b", 0.2, 3), ("small", 0.2, 2), ("absent", 0.1, 2)], "source string, target_share double, repeat_cap int")


def test_mix_reaches_its_budgets(spark):
    docs, goals = documents(spark), targets(spark)
    from pressmill.llm.tokens import encoding, vocabulary

    tok = encoding(vocabulary())
    size = {r.doc_id: len(tok.encode_ordinary(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    supply = {}
    for k, s in source.items():
        supply[s] = supply.get(s, 0) + size[k]
    want = M.budgets({s: v for s, v in supply.items() if s}, {r.source: (r.target_share, r.repeat_cap) for r in goals.collect()})
    mixed = M.mix(docs, goals, "doc_id", "text", "source").collect()
    got, caps = {}, {r.source: r.repeat_cap for r in goals.collect()}
    for r in mixed:
        assert source[r.doc_id] == r.source and size[r.doc_id] == r.n_tokens > 0 and 1 <= r.copies <= caps[r.source]
        got[r.source] = got.get(r.source, 0) + r.n_tokens * r.copies
    assert len({r.doc_id for r in mixed}) == len(mixed)
    for s in ("hot", "b", "small"):
        assert abs(got[s] - want[s]) <= max(v for k, v in size.items() if source[k] == s)
    again = M.mix(docs, goals, "doc_id", "text", "source").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))
    report = {r.source: r for r in M.shares(M.mix(docs, goals, "doc_id", "text", "source"), goals).collect()}
    assert report["absent"].mix_tokens == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-4)


def test_empty_and_refused(spark):
    docs, goals = documents(spark, 5), targets(spark)
    assert M.mix(docs.limit(0), goals, "doc_id", "text", "source").count() == 0
    assert M.shares(M.mix(docs, goals.limit(0), "doc_id", "text", "source"), goals.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, goals.unionAll(goals), "doc_id", "text", "source")


def test_draws_do_not_see_where_batches_end():
    """Rows of one sorted partition, repeated keys among them, cut into batches anywhere."""
    import pandas as pd

    r = random.Random(6)
    rows = sorted(((r.randrange(150), r.choice("ab"), r.randrange(1, 9)) for _ in range(400)), key=lambda x: (-x[2], x[0]))
    frame = pd.DataFrame(rows, columns=["k", "source", "n_tokens"]).assign(whole=0, fraction=0.37)

    def drawn(cuts):
        state, seen, out = {}, {}, []
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            out += M._pivot_rows("k", frame.iloc[a:b], 17, state, seen)
        return sorted(out), sorted((s, *v) for s, v in state.items())

    assert drawn([]) == drawn([7, 90, 91, 300]) == drawn(list(range(5, 400, 5)))
