"""First deliveries, cut-off, and counters that retries and order cannot change."""

import random

import pytest
from pyspark.sql import functions as F

from pressmill.operators import counters as C
from pressmill.streaming import flows

DAY = 86400
COLUMNS = "id string, intake bigint, rec bigint, ev bigint, pub string, day string"


def deliveries(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], COLUMNS)


def first(df, hours=72):
    return C.first_deliveries(df, F.col("id"), F.col("intake"), F.col("rec"), F.col("ev"), F.col("pub"), hours)


def brute(rows, hours=72):
    best = {}
    for i, intake, rec, ev, pub in rows:
        if i is not None and intake is not None and (i not in best or (intake, rec) < best[i][:2]):
            best[i] = (intake, rec, ev, pub)
    late, counts = set(), {}
    for intake, rec, ev, pub in best.values():
        if ev is None:
            continue
        day = ev // DAY
        if intake > ((day + 1) * DAY + hours * 3600) * 1_000_000:
            late.add(rec)
        else:
            counts[(day, pub)] = counts.get((day, pub), 0) + 1
    return late, counts


def some_rows(n=400, seed=5):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ev = r.choice([None, *[r.randrange(20 * DAY) for _ in range(6)]])
        base = (ev or 0) + r.choice([0, DAY, 3 * DAY, 5 * DAY]) + r.randrange(DAY)
        out.append((r.choice([None, *[f"e{r.randrange(n // 2)}" for _ in range(8)]]), r.choice([None, *[base * 1_000_000] * 9]), k, ev, r.choice([None, "a", "a", "b"])))
    return out


def state_of(spark, rows):
    return C.begin(first(deliveries(spark, rows)))


def counted(state):
    """Late record ids and counts by (day, key) of a state; both come from the counters."""
    late = {r.tie for r in C.late_deliveries(state).collect()}
    rows = C.totals(state.counters).collect()
    assert sum(r.n_late for r in rows) == len(late)
    return late, {(r.day, r.key): r.n for r in rows if r.n}


def test_against_brute_force(spark):
    rows = some_rows()
    assert counted(state_of(spark, rows)) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_any_split_order_and_retry_gives_the_same_counts(spark, seed):
    r = random.Random(seed)
    rows = some_rows(160, seed + 20)
    parts = [[] for _ in range(r.randrange(2, 5))]
    for row in rows:
        for k in r.sample(range(len(parts)), r.choice([1, 1, 1, 2])):  # some deliveries reach two batches
            parts[k].append(row)
    states = [state_of(spark, p) for p in parts]
    order = [*range(len(parts)), r.randrange(len(parts))]
    r.shuffle(order)
    assert counted(C.merge_states(*[states[k] for k in order])) == brute(rows)


def test_separate_batches_of_one_day_add_up(spark):
    a, b = ([(f"{name}{k}", 5, k, 0, "p") for k in range(40)] for name in "ab")
    merged = C.merge_states(state_of(spark, a), state_of(spark, b))
    assert counted(merged)[1] == {(0, "p"): 80}
    assert counted(C.merge_states(merged, state_of(spark, b), state_of(spark, a)))[1] == {(0, "p"): 80}


def test_an_earlier_delivery_moves_its_event(spark):
    late_first = C.merge_states(state_of(spark, [("x", 9 * DAY, 1, 4 * DAY, "p")]), state_of(spark, [("x", 8 * DAY, 2, 3 * DAY, "q")]))
    assert counted(late_first)[1] == {(3, "q"): 1}
    rows = {(r.day, r.key, r.version, r.n) for r in late_first.counters.collect()}
    assert rows == {(4, "p", 1, 1), (4, "p", 2, 0), (3, "q", 2, 1)}


def test_cut_off_is_exact(spark):
    limit = (DAY + 72 * 3600) * 1_000_000
    f = first(deliveries(spark, [("a", limit, 1, 0, "p"), ("b", limit + 1, 2, 0, "p")]))
    assert {r.identity: r.late for r in f.collect()} == {"a": False, "b": True}


def test_counter_rows_may_come_again_and_in_any_order(spark):
    rows = some_rows(seed=7)
    state = C.merge_states(state_of(spark, rows[:150]), state_of(spark, rows[150:]))
    parts = state.counters.randomSplit([1.0, 1.0, 1.0], 3)
    whole = sorted(map(tuple, C.merge_snapshots(state.counters).collect()), key=repr)
    assert sorted(map(tuple, C.merge_snapshots(parts[2], parts[0], parts[1], parts[0], state.counters).collect()), key=repr) == whole


def test_stream_against_brute_force_with_restart(spark, tmp_path):
    rows = some_rows(240, 11)
    source, path = tmp_path / "in", str(tmp_path / "flow")
    source.mkdir()
    schema = deliveries(spark, []).schema

    def arrive(part, name):
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(str(source / name))

    def run():
        stream = flows.files_stream(spark, f"{source}/*", schema)
        return {(r.day, r.key): r.n for r in flows.corrected_counts(stream, first, path).collect() if r.n}

    assert run() == {}
    arrive(rows[:80], "a")
    arrive(rows[60:130], "b")  # twenty come again
    run()
    arrive(rows[130:], "c")
    assert run() == brute(rows)[1]
    assert run() == brute(rows)[1]


@pytest.mark.parametrize("rows", [[], [(None, 1, 1, 1, None)], [("a", None, 1, 1, None)]])
def test_nothing_to_count(spark, rows):
    f = first(deliveries(spark, rows))
    assert f.count() == 0 and C.begin(f).counters.count() == 0 and C.totals(C.advance(C.begin(f), f).counters).count() == 0


def test_hot_key_and_ties(spark):
    rows = [(f"e{k // 2}", 5, k, 0, "hot") for k in range(2000)]
    f = first(deliveries(spark, rows))
    assert f.count() == 1000 and f.agg(F.sum("tie")).first()[0] == sum(range(0, 2000, 2))
    assert C.totals(C.begin(f).counters).first().n == 1000
