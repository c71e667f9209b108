"""Records that share most of their words, found without comparing all pairs.

Set similarity join by token combinations. Every text is its set of distinct words.
Words are ordered from rare to frequent by a sketch of their counts over all rows, and
put into classes by that count: a word of the first class is a signature alone, words of
class k > 1 only as combinations of k of them. If two sets are alike enough, at most ``d``
words of one are missing from the other, so its prefix is extended until the classes'
counts give more than ``d`` chances (a class with c words gives c - k + 1): one of the
classes then keeps k shared words, and both sets carry that combination. The larger set
of a pair probes with the prefix for the smallest partner it may have; the smaller one is
indexed with the shorter prefix for partners of at least its own size. Signatures met in
an equi-join are screened by size and by a bitmap bound on the symmetric difference, and
the survivors are verified on the 32-bit hashes of their words (two different words of a pair
of texts share one with a chance below one in a million).

Texts with the same word set form one class before any signature is written, so copies,
however many, cost one signature set. Pairs are found between classes; ``member_pairs``
expands them where pairs of records are wanted.

Sketches of bounded size hold the counts of all words and mark the signatures in the index,
so that signatures without a partner are not written; collisions only cost time. Nothing
is capped.

Defined results: null texts and texts without words are in no class; sets of fewer than
three words match only their equals at thresholds of 0.75 and more; repeated rows are
members of one class; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.shared import materialize, ship

_WORD = re.compile(r"[^\W_]+")
CLASS_FACTORS = (3, 30)
"""Largest counts of a word of class 1 and 2, in square roots of the number of sets; more frequent ones are of class 3."""
PLAIN = 128
"""Longest sets whose classes stay whole; in longer ones words of class 2 and 3 are combined within groups by hash."""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat_word_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's distinct lower-cased words, sorted within the text, and their numbers."""
    digest = xxhash.xxh32_intdigest
    hashes: list[int] = []
    counts = []
    for text in texts:
        words = set(_WORD.findall(text.lower()))
        hashes += map(digest, words)
        counts.append(len(words))
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    both = np.unique((rows << np.uint64(32)) | np.asarray(hashes, np.uint64)) if hashes else np.zeros(0, np.uint64)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def word_sets(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, set_id, tokens): each row's word set, as a table in the shared folder; sets of different groups differ."""
    ship(df.sparkSession)
    rows = df.select(group, key, F.col(text).alias("_text")).where("_text is not null")
    schema = f"`{group}` string, `{key}` {df.schema[key].dataType.simpleString()}, set_id bigint, tokens array<int>"

    def run(batches):
        for batch in batches:
            tokens, sizes = flat_word_sets(batch.column(2).to_pylist())
            ends = np.cumsum(sizes)
            raw = tokens.tobytes()
            seeds = {name: xxhash.xxh64_intdigest(str(name)) for name in set(batch.column(0).to_pylist())}
            ids = [xxhash.xxh64_intdigest(raw[4 * (e - n) : 4 * e], seed=seeds[name]) - 2**63 for e, n, name in zip(ends.tolist(), sizes.tolist(), batch.column(0).to_pylist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens.view(np.int32)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), lists], names=[group, key, "set_id", "tokens"])
            yield out.filter(pa.array(sizes > 0))

    return materialize(rows.mapInArrow(run, schema), "word-sets")


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.diff(lists.offsets.to_numpy())


def _counted(df: DataFrame, cells_of, cells: int, most: int) -> DataFrame:
    """(cell, n): how often each hash cell occurs over all rows, each partition's count held at ``most``."""

    def run(batches):
        counts = np.zeros(cells, np.uint32 if most > 255 else np.uint8)
        for batch in batches:
            found, n = np.unique(cells_of(batch), return_counts=True)
            counts[found] = np.minimum(counts[found].astype(np.int64) + n, most)
        used = np.flatnonzero(counts)
        for start in range(0, len(used), 100_000):
            part = used[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int32))], names=["cell", "n"])

    return df.mapInArrow(run, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))


def cell_levels(df: DataFrame, cells_of, bits: int) -> np.ndarray:
    """8 times the base-2 logarithm of each cell's count, plus one, in a byte; 0 where it is below 2.

    Eight cells make a row, so at most ``2**(bits - 3)`` rows reach the driver, whatever the data.
    """
    level = F.least(F.lit(255), F.floor(F.log2(F.col("n").cast("double")) * 8) + 1).cast("bigint")
    placed = F.call_function("shiftleft", level, F.pmod("cell", F.lit(8)) * 8)
    table = _counted(df, cells_of, 1 << bits, 2**31 - 1).where("n > 1").groupBy(F.shiftright("cell", 3).alias("word")).agg(F.bit_or(placed).alias("levels"))
    out = np.zeros(1 << (bits - 3), np.int64)
    for batch in table.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.astype("<i8").view(np.uint8)


def cell_flags(df: DataFrame, cells_of, cells: int, least: int) -> np.ndarray:
    """One bit per cell, set where it occurs at least ``least`` times; 64 cells to a row that reaches the driver."""
    table = _counted(df, cells_of, cells, least).where(F.col("n") >= least)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("cell", F.lit(64)))
    out = np.zeros((cells + 63) // 64, np.int64)
    for batch in table.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _flagged(flags: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (flags[cells >> 6] >> (cells & 63)) & 1 > 0


def _level(count: int) -> int:
    return int(np.floor(np.log2(count) * 8) + 1)


def _runs(row: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal values."""
    first = np.r_[True, row[1:] != row[:-1]]
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def signatures(tokens: np.ndarray, sizes: np.ndarray, levels: np.ndarray, threshold: float, limits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, indexed) of all sets; ``tokens`` are the sets one after the other, ``levels`` their counts' levels.

    Sets write their signatures in rounds by size: two classes for at most five words
    (three classes may leave a set three chances short, which small sets may lack), three
    classes beyond. Rounds overlap so far that a pair alike enough always has both its sets in
    one of them. Combinations of long sets would be too many, so each round of more than ``PLAIN``
    words, doubling in size, spreads the words of class 2 and 3 over groups by their hash and combines
    within a group: a group with c words of class k gives c - k + 1 chances. A round has a group
    for every six words of its smallest set, so that at most half of a set's chances are lost.
    """
    rows = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    order = np.argsort((rows << np.uint64(40)) | (levels.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64))
    rows, tokens, levels = rows[order].astype(np.int64), tokens[order].astype(np.uint64), levels[order]
    same = sizes - np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-9).astype(int)
    least = sizes - np.ceil(threshold * sizes - 1e-9).astype(int)
    out_rows, out_keys, out_index = [], [], []
    rounds = [((sizes <= 5), 1), ((sizes >= 4) & (sizes <= PLAIN), 1)]
    low = PLAIN
    while low < sizes.max(initial=0):
        rounds.append(((sizes > threshold * low) & (sizes <= 2 * low), max(1, int(threshold * low / 6))))
        low *= 2
    for part, (use, groups) in enumerate(rounds):
        pick = use[rows]
        if not pick.any():
            continue
        row, token, level = rows[pick], tokens[pick], levels[pick]
        kind = np.ones(len(row), np.int64)
        for limit in limits[: 1 if part == 0 else 2]:
            kind += level > _level(limit)
        group = kind.copy()
        if groups > 1:  # words of one class and group follow each other
            group = np.where(kind > 1, kind * groups + (_mix(token) % np.uint64(groups)).astype(np.int64), kind)
            again = np.lexsort((token, level, group, kind, row))
            row, token, level, kind, group = (x[again] for x in (row, token, level, kind, group))
        place = _runs(row * (4 * groups + 4) + group)  # position in the row's class or group
        chance = (place >= kind - 1).astype(np.int64)
        total = np.cumsum(chance)
        begin = _runs(row) == 0
        base = np.maximum.accumulate(np.where(begin, total - chance, 0))
        before = total - chance - base
        inside = before <= least[row]
        row, token, level, kind, place, before = (x[inside] for x in (row, token, level, kind, place, before))
        index = before <= same[row]
        seed = np.uint64(0x9E3779B97F4A7C15 + part)

        def emit(at: np.ndarray, *others: np.ndarray, row=row, token=token, index=index, seed=seed) -> None:
            key = _mix(token[at] + seed)
            for other in others:
                key = _mix(key * np.uint64(0x2545F4914F6CDD1D) + token[other])
            out_rows.append(row[at])
            out_keys.append(key)
            out_index.append(index[at])

        emit(np.flatnonzero((kind == 1) & (level > 1)))
        two = np.flatnonzero((kind == 2) & (place > 0))
        for lag in range(1, int(place[two].max(initial=0)) + 1):
            at = two[place[two] >= lag]
            emit(at, at - lag)
        three = np.flatnonzero((kind == 3) & (place > 1))
        longest = int(place[three].max(initial=0))
        for lag in range(1, longest):
            for far in range(lag + 1, longest + 1):
                at = three[place[three] >= far]
                if len(at):
                    emit(at, at - lag, at - far)
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(out_rows), np.concatenate(out_keys), np.concatenate(out_index)


def bitmaps(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, one set per word; sets are not empty."""
    at = _mix(tokens.astype(np.uint64)) & np.uint64(127)
    bit = np.uint64(1) << (at & np.uint64(63))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = np.bitwise_or.reduceat(np.where(at < 64, bit, np.uint64(0)), starts)
    high = np.bitwise_or.reduceat(np.where(at < 64, np.uint64(0), bit), starts)
    return low.view(np.int64), high.view(np.int64)


def similar_classes(sets: DataFrame, group: str, threshold: float = 0.8, sketch_bits: int | None = None, limits: tuple[int, int] | None = None) -> DataFrame:
    """(set_a, set_b, likeness) of all pairs of different word sets of one group alike at or above the threshold.

    The sketches have about four cells of counts for each set and sixteen marks, but no
    more than ``2**24`` and ``2**25``: what is broadcast stays below 32 MB.
    """
    context = sets.sparkSession.sparkContext
    # copies, however many, are one row from here on
    plain = materialize(sets.select("set_id", "tokens", F.xxhash64(group).alias("part")).dropDuplicates(["set_id"]), "distinct-sets")
    n_sets = plain.count()
    limits = limits or tuple(max(1, int(factor * n_sets**0.5)) for factor in CLASS_FACTORS)
    if sketch_bits is None:
        sketch_bits = min(24, max(12, n_sets.bit_length() + 2))
    word_mask, flag_cells = np.uint64((1 << sketch_bits) - 1), 1 << min(25, sketch_bits + 2)
    flag_mask = np.uint64(flag_cells - 1)

    def word_cells(tokens: np.ndarray) -> np.ndarray:
        return (tokens.astype(np.uint64) & word_mask).astype(np.int64)

    words = context.broadcast(cell_levels(plain.select("tokens"), lambda batch: word_cells(_flat(batch, 0)[0]), sketch_bits))

    def signed(batch: pa.RecordBatch):
        """Words and sizes of a batch's sets; row, key, cell and index flag of their signatures, none shared between groups."""
        tokens, sizes = _flat(batch, 1)
        row, keys, index = signatures(tokens, sizes, np.maximum(words.value[word_cells(tokens)], 1), threshold, limits)
        keys = _mix(keys ^ batch.column(2).to_numpy().view(np.uint64)[row])
        return tokens, sizes, row, keys, (keys & flag_mask).astype(np.int64), index

    def written_cells(batch: pa.RecordBatch) -> np.ndarray:
        *_, cells, index = signed(batch)
        # the second half marks what is in the index; one mark counts as two
        return np.concatenate([cells, np.repeat(cells[index] + flag_cells, 2)])

    flags = context.broadcast(cell_flags(plain, written_cells, 2 * flag_cells, 2))
    schema = "signature bigint, set_id bigint, n int, indexed boolean, low bigint, high bigint"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            tokens, sizes, row, keys, cells, index = signed(batch)
            keep = _flagged(flags.value, cells) & (index | _flagged(flags.value, cells + flag_cells))
            row, keys, index = row[keep], keys[keep], index[keep]
            low, high = bitmaps(tokens, sizes)
            columns = [keys.view(np.int64), ids[row], sizes[row].astype(np.int32), index, low[row], high[row]]
            for start in range(0, len(row), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 200_000]) for c in columns], names=["signature", "set_id", "n", "indexed", "low", "high"])

    rows = plain.mapInArrow(run, schema)
    # both sides are one exchange by signature that the planner made, so adaptive execution may split a hot signature
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) + F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
    most = (1 - threshold) / (1 + threshold)
    na, nb = F.col("a.n"), F.col("b.n")
    alike = (
        # which side must be in the index is said in terms of both, lest it be filtered before the exchange and make it two
        F.when(F.col("a.indexed"), F.col("b.indexed").isNotNull()).otherwise(False)
        & ((na < nb) | ((na == nb) & (F.col("a.set_id") < F.col("b.set_id")))) & (na >= nb * threshold - 1e-9) & (apart <= (na + nb) * most + 1e-9)
    )
    # of equal sizes the smaller id is taken from the index: both are in it
    pairs = materialize(a.join(b, (F.col("a.signature") == F.col("b.signature")) & alike).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b")).distinct(), "candidates")

    def id_cells(ids: np.ndarray) -> np.ndarray:
        return (_mix(ids.view(np.uint64)) & flag_mask).astype(np.int64)

    # only the sets of candidates move, each once
    wanted = context.broadcast(cell_flags(pairs, lambda x: id_cells(np.concatenate([x.column(0).to_numpy(), x.column(1).to_numpy()])), flag_cells, 1))

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(_flagged(wanted.value, id_cells(batch.column(0).to_numpy()))))

    tokens = plain.select("set_id", "tokens").mapInArrow(chosen, "set_id bigint, tokens array<int>")
    joined = pairs.join(tokens.select(F.col("set_id").alias("set_a"), F.col("tokens").alias("ta")), "set_a")
    joined = joined.join(tokens.select(F.col("set_id").alias("set_b"), F.col("tokens").alias("tb")), "set_b")
    both = F.size(F.array_intersect("ta", "tb"))
    likeness = both / (F.size("ta") + F.size("tb") - both)
    return joined.select(F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"), likeness.alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def member_pairs(sets: DataFrame, classes: DataFrame, group: str, key: str) -> DataFrame:
    """(group, a, b) with a < b: keys of one group whose rows are alike, from similar classes and from within classes."""
    members = sets.select(group, "set_id", key).repartition("set_id").distinct()
    a = members.select(group, F.col("set_id").alias("set_a"), F.col(key).alias("ka"))
    b = members.select(F.col(group).alias("_group"), F.col("set_id").alias("set_b"), F.col(key).alias("kb"))
    across = classes.select("set_a", "set_b").join(a, "set_a").join(b, "set_b").where(F.col(group) == F.col("_group"))
    within = a.join(b, a["set_a"] == b["set_b"]).where("ka < kb")
    out = across.where("ka <> kb").select(group, F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return out.unionAll(within.select(group, F.col("ka").alias("a"), F.col("kb").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(set_id, group_id): sets that links (set_a, set_b) join, directly or over others; the least id names the group.

    Every round takes the least label of the neighbours and then the label of that label,
    so chains shorten by half; each round is a table in the shared folder.
    """
    edges = links.select(F.col("set_a").alias("x"), F.col("set_b").alias("y"))
    edges = materialize(edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = materialize(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("x").alias("new"), F.col("label").alias("far"))
        moved = materialize(step.join(jump, "new", "left").select("x", "old", F.least("new", F.coalesce("far", "new")).alias("label")), "labels")
        if moved.where("old <> label").isEmpty():
            return moved.select(F.col("x").alias("set_id"), F.col("label").alias("group_id"))
        labels = moved.select("x", "label")


def grouped_records(sets: DataFrame, classes: DataFrame, group: str, key: str) -> DataFrame:
    """One row per record key and word set: its set, its group of alike sets, and the links of its set to others."""
    sides = classes.select(F.col("set_a").alias("set_id")).unionAll(classes.select(F.col("set_b").alias("set_id")))
    degree = sides.groupBy("set_id").agg(F.count("*").alias("n_links"))
    members = sets.select(group, key, "set_id").distinct()
    joined = members.join(components(classes), "set_id", "left").join(degree, "set_id", "left")
    return joined.select(group, key, "set_id", F.coalesce("group_id", "set_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def has_han(text: Column) -> Column:
    return text.rlike(r"\p{IsHan}")
