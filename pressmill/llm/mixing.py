"""Sources mixed to target shares of tokens, each record copied at most a capped number of times.

Each source's token budget follows from the targets by filling: where a source's cap
binds, the others take up what it lacks in proportion to their targets, so that the mix
keeps its size as far as the caps of all allow. A source's budget gives every one of its
records the same expected number of copies; the whole part is fixed and the fraction is
rounded by pivotal dependent rounding: two fractional records exchange token mass at
random until one of them is integral, which keeps the source's token sum. Records are
spread by key over partitions of bounded size; each pairs its records in one pass, heaviest
first, holding one residual per source; the residuals are paired again in a reduction tree over salted groups, and each source's last one is
rounded at random.

Defined results: records of a source without target, or with null source, are left out;
targets of sources without records stay at zero; null or empty texts have no tokens and
are never copied; shares are scaled to sum to one; a source listed twice is refused; repeated
keys are rounded each for itself; empty tables give empty results. Draws depend on keys,
sizes and seed only, so a repeated run gives the same mix.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.tokens import VOCABULARY, count_tokens_udf
from pressmill.shared import materialize, ship

_TINY = 1e-9


def budgets(supply: dict[str, float], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Token budget per source: the size of all supplies together, shared by targets under the caps."""
    total = float(sum(supply.get(s, 0) for s in targets))
    scale = sum(share for share, _ in targets.values())
    if not total or not scale:
        return dict.fromkeys(targets, 0.0)
    out: dict[str, float] = {}
    open_sources = {s: share / scale for s, (share, _) in targets.items()}
    while open_sources:
        rest, shares = total - sum(out.values()), sum(open_sources.values())
        wanted = {s: rest * share / shares if shares else 0.0 for s, share in open_sources.items()}
        full = [s for s in open_sources if wanted[s] >= supply.get(s, 0) * targets[s][1] - _TINY]
        if not full:
            return out | wanted
        for s in full:
            out[s] = float(supply.get(s, 0) * targets[s][1])
            del open_sources[s]
    return out


def _draw(seed: int, a, b) -> float:
    digest = hashlib.blake2b(f"{seed}|{a}|{b}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivot(records, seed: int):
    """Pair fractional records (key, weight, fraction) one after the other.

    Yields (key, extra copy 0 or 1) for each that becomes integral; returns the one
    residual that is left, or None.
    """
    held = None
    for key, weight, p in records:
        if weight <= 0 or p <= _TINY:
            yield key, 0
            continue
        if p >= 1 - _TINY:
            yield key, 1
            continue
        if held is None:
            held = (key, weight, p)
            continue
        k, w, q = held
        up = min(1 - q, p * weight / w)
        down = min(q, (1 - p) * weight / w)
        if _draw(seed, k, key) * (up + down) < down:
            q2, p2 = q + up, p - up * w / weight
        else:
            q2, p2 = q - down, p + down * w / weight
        held = None
        for kk, ww, pp in ((k, w, q2), (key, weight, p2)):
            if pp <= _TINY:
                yield kk, 0
            elif pp >= 1 - _TINY:
                yield kk, 1
            else:
                held = (kk, ww, pp)
    return held


def _pivot_rows(key: str, frame: pd.DataFrame, seed: int, state: dict, seen: dict) -> list[tuple]:
    """Run each source's records through its pivot; state holds one residual per source, seen the last key and how often it came."""
    rows = []
    # heaviest first: a heavy record's fraction is settled by the lighter ones after it, so what is left is light
    ordered = frame.sort_values(["n_tokens", key], ascending=[False, True])
    for source, part in ordered.groupby("source", sort=True):
        # records go by (key, size, occurrence), so that repeated keys stay apart and no draw sees where a batch ends
        held = state.pop(source, None)
        last, times = seen.get(source, (None, -1))
        places = []
        for k in zip(part[key], part["n_tokens"], strict=True):
            last, times = (k, times + 1) if k == last else (k, 0)
            places.append((*k, times))
        seen[source] = (last, times)
        keys = [*([held[0]] if held else []), *places]
        sizes = [*([held[1]] if held else []), *part["n_tokens"]]
        fractions = [*([held[2]] if held else []), *part["fraction"]]
        whole = dict(zip(keys, zip(sizes, [*([held[3]] if held else []), *part["whole"]], strict=True), strict=True))
        run = pivot(zip(keys, sizes, fractions, strict=True), seed)
        while True:
            try:
                k, extra = next(run)
            except StopIteration as end:
                left = end.value
                break
            rows.append((k[0], source, whole[k][0], whole[k][1] + extra, 0.0, True))
        if left:
            state[source] = (left[0], left[1], left[2], whole[left[0]][1])
    return rows


def mix(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, seed: int = 17, fan: int = 64, rows_per_leaf: int = 100_000, path: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens, copies) of every record that the mix takes at least once."""
    spark = df.sparkSession
    ship(spark)
    wanted = [(r.source, float(r.target_share or 0), int(r.repeat_cap or 0)) for r in targets.where("source is not null").select("source", "target_share", "repeat_cap").collect()]
    if len({s for s, _, _ in wanted}) < len(wanted):
        raise ValueError("a source has two targets")
    plan = spark.createDataFrame([(s,) for s, _, _ in wanted], "source string")
    count = count_tokens_udf(spark, path)
    named = df.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("_text")).join(F.broadcast(plan), "source", "left_semi")
    counted = materialize(named.select(key, "source", F.coalesce(count("_text"), F.lit(0)).cast("bigint").alias("n_tokens")), "mix-tokens")
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()  # a row per target
    supply, n_rows = {r.source: r.n for r in sums}, sum(r.rows for r in sums)
    budget = budgets(supply, {s: (share, cap) for s, share, cap in wanted})
    rates = [(s, budget[s] / supply[s] if supply.get(s) else 0.0) for s, _, _ in wanted]
    rated = counted.join(F.broadcast(spark.createDataFrame(rates, "source string, rate double")), "source")
    rated = rated.withColumn("whole", F.floor(F.col("rate") + _TINY).cast("int")).withColumn("fraction", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rated = rated.where("n_tokens > 0").select(key, "source", "n_tokens", "whole", "fraction")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, source string, n_tokens bigint, whole int, fraction double, done boolean"
    columns = [key, "source", "n_tokens", "whole", "fraction", "done"]

    def leaf(batches):
        state: dict = {}
        seen: dict = {}
        for pdf in batches:
            yield pd.DataFrame(_pivot_rows(key, pdf, seed, state, seen), columns=columns)
        yield pd.DataFrame([(k[0], s, w, whole, p, False) for s, (k, w, p, whole) in sorted(state.items())], columns=columns)

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        rows = _pivot_rows(key, pdf, seed + 1, state, {})
        rows += [(k[0], s, w, whole, p, False) for s, (k, w, p, whole) in sorted(state.items())]
        return pd.DataFrame(rows, columns=columns)

    # partitions by key, sorted: how the input is laid out has no say in what is drawn
    parts = rated.repartition(max(1, -(-n_rows // rows_per_leaf)), key).sortWithinPartitions(F.desc("n_tokens"), key)
    step = materialize(parts.mapInPandas(leaf, schema), "mix-leaves")
    level = step.where("not done").groupBy("source", F.pmod(F.xxhash64(key), F.lit(fan)).alias("_salt")).applyInPandas(lambda pdf: node(pdf.drop(columns="_salt", errors="ignore")), schema)
    level = materialize(level, "mix-nodes")
    root = level.where("not done").groupBy("source").applyInPandas(node, schema)
    last = F.when(F.col("done"), 0).otherwise((F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.col("fraction")).cast("int"))
    final = step.where("done").unionAll(level.where("done")).unionAll(root)
    out = final.select(key, "source", "n_tokens", (F.col("whole") + last).alias("copies"))
    return out.where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share, tokens and copies in the mix, records taken."""
    sums = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("n_copies"), F.count("*").alias("n_records"), F.max("copies").alias("most_copies"))
    rows = targets.where("source is not null").select("source", "target_share", "repeat_cap").join(sums, "source", "left")
    rows = rows.withColumn("total", F.sum("mix_tokens").over(Window.partitionBy(F.lit(1))))  # a row per target
    return rows.select(
        "source", "target_share", "repeat_cap", F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.try_divide(F.coalesce("mix_tokens", F.lit(0)), "total"), 6).alias("actual_share"),
    )
