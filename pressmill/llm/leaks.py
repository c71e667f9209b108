"""Held-out items whose passages occur in corpus documents.

A passage is ``passage`` consecutive words, compared without case, accents, punctuation,
spacing and invisible format characters. Candidates come from a size-partitioned MinHash
containment search: documents are cut into overlapping windows of twice the passage, so
that each passage lies whole in one of them; the windows are partitioned by their number
of word shingles, and each partition draws as many min-hashes as its upper size bound
needs for a passage's shingles, all of them contained, to be missed with a probability
of at most ``miss``. A passage that repeats itself has fewer distinct shingles than that
counts on, so it is looked up whole instead. A candidate is kept only if a passage's whole words are found in
the document (exact shingle containment).

Items are a stated query set: they are sent to the executors in blocks of bounded size
and every document row is read once per block; nothing of the documents is shuffled.

Defined results: null or wordless texts and items shorter than a passage match nothing;
each (document key, item) pair is returned once per document row; repeated items are
reported under each of their ids; empty tables give an empty result; other columns are
left unread.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.shared import ship

_WORD = re.compile(r"[^\W_]+")
_LIMIT = np.uint64(2**64 - 1)


@cache
def _ignored(last: int) -> re.Pattern:
    spans, start = [], None
    for code in range(last + 2):
        drop = code <= last and unicodedata.category(chr(code)) in ("Mn", "Me", "Cf")
        if drop and start is None:
            start = code
        elif not drop and start is not None:
            spans.append(f"{chr(start)}-{chr(code - 1)}")
            start = None
    return re.compile("[" + "".join(spans) + "]+")


# A class within the basic plane is matched by table; the whole one is made and tried only where it is needed.
_IGNORED = _ignored(0xFFFE)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits after folding case, accents and format characters."""
    folded = text.casefold()
    if not folded.isascii():
        folded = unicodedata.normalize("NFKD", folded)
        folded = (_IGNORED if max(folded) < "\uffff" else _ignored(sys.maxunicode)).sub("", folded)
    return _WORD.findall(folded)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[str]) -> np.ndarray:
    return _mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; one entry per start that has n words left."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15 | 1) + hashes[k : k + m]
    return _mix(out)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs


class PassageIndex:
    """Min-hashes of all passages of a block of items, and their exact words."""

    def __init__(self, items: list[tuple[int, str]], passage: int, shingle: int, miss: float):
        self.passage, self.shingle = passage, shingle
        self.inside = passage - shingle + 1  # shingles of a passage
        self.window = 2 * passage
        # size partitions by number of shingles; the last bound is that of a whole window
        top = self.window - shingle + 1
        self.bounds = sorted({self.inside, (self.inside + top) // 2, top})
        self.draws = [1 if u == self.inside else math.ceil(math.log(miss) / math.log(1 - self.inside / u)) for u in self.bounds]
        self.seeds = _mix(np.arange(1, max(self.draws) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.exact: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        repetitive: list[np.ndarray] = []
        found: list[list[np.ndarray]] = [[] for _ in self.seeds]
        owner: list[np.ndarray] = []
        for key, text in items:
            words = words_of(text) if text else []
            if len(words) < passage:
                continue
            h = _hashes(words)
            small = _grams(h, shingle)
            count = len(words) - passage + 1
            owner.append(np.full(count, key, np.int64))
            for b, seed in enumerate(self.seeds):
                v = _mix(small ^ seed)
                found[b].append(np.lib.stride_tricks.sliding_window_view(v, self.inside).min(axis=1))
            whole = _grams(h, passage)
            ordered = np.sort(np.lib.stride_tricks.sliding_window_view(small, self.inside), axis=1)
            repetitive.append(whole[(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)])
            for at, g in enumerate(whole.tolist()):
                self.exact.setdefault(g, []).append((key, tuple(words[at : at + passage])))
        self.keys = np.sort(np.fromiter(self.exact, np.uint64, len(self.exact)))
        self.repetitive = np.unique(np.concatenate(repetitive)) if repetitive else np.zeros(0, np.uint64)
        self.tables = []
        owners = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        for values in found:
            v = np.concatenate(values) if values else np.zeros(0, np.uint64)
            pairs = np.unique(np.rec.fromarrays([v, owners], names="v,o")) if len(v) else np.rec.fromarrays([v, owners], names="v,o")
            self.tables.append((np.ascontiguousarray(pairs["v"]), np.ascontiguousarray(pairs["o"])))

    def candidates(self, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(owner of a window, item) rows that share a min-hash; a window's shingles are small[start:end]."""
        sizes = ends - starts
        out = [np.zeros((0, 2), np.int64)]
        low = 0
        for bound, draws in zip(self.bounds, self.draws, strict=True):
            pick = np.flatnonzero((sizes > low) & (sizes <= bound) & (sizes >= self.inside))
            low = bound
            if not len(pick):
                continue
            cuts = np.empty(2 * len(pick), np.int64)
            cuts[0::2], cuts[1::2] = starts[pick], ends[pick]
            for b in range(draws):
                values, owners = self.tables[b]
                if not len(values):
                    continue
                hashed = np.append(_mix(small ^ self.seeds[b]), _LIMIT)
                least = np.minimum.reduceat(hashed, cuts)[0::2]
                left = np.searchsorted(values, least, "left")
                right = np.searchsorted(values, least, "right")
                hit = np.flatnonzero(right > left)
                n = right[hit] - left[hit]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs = np.stack([np.repeat(owner[pick[hit]], n), owners[np.repeat(left[hit], n) + inner]], axis=1)
                out.append(_distinct(pairs))
        return _distinct(np.concatenate(out))

    def search(self, texts: list[str | None], block_words: int = 1_000_000) -> list[tuple[int, int, int]]:
        """(index of text, item, passages found) for every text that holds a passage of an item."""
        out: list[tuple[int, int, int]] = []
        block: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            if len(words) >= self.passage:
                block.append((i, words))
                held += len(words)
            if held >= block_words:
                out += self._search(block)
                block, held = [], 0
        return out + self._search(block)

    def _search(self, block: list[tuple[int, list[str]]]) -> list[tuple[int, int, int]]:
        if not block or not self.exact:
            return []
        parts, starts, ends, owner, at = [], [], [], [], 0
        hashed = []
        for k, (_, words) in enumerate(block):
            h = _hashes(words)
            hashed.append(h)
            small = _grams(h, self.shingle)
            s = np.arange(0, max(1, len(words) - self.passage + 1), self.passage)
            e = np.minimum(s + self.window - self.shingle + 1, len(small))
            parts.append(small)
            starts.append(s + at)
            ends.append(e + at)
            owner.append(np.full(len(s), k))
            at += len(small)
        owners = np.concatenate(owner)
        out = []
        by_text: dict[int, set[int]] = {}
        for k, item in self.candidates(np.concatenate(parts), np.concatenate(starts), np.concatenate(ends), owners).tolist():
            by_text.setdefault(k, set()).add(item)
        if len(self.repetitive):
            for k, h in enumerate(hashed):
                for g in np.intersect1d(_grams(h, self.passage), self.repetitive).tolist():
                    by_text.setdefault(k, set()).update(item for item, _ in self.exact[g])
        for k, items in sorted(by_text.items()):
            index, words = block[k]
            hits: dict[int, int] = {}
            grams = _grams(hashed[k], self.passage)
            near = np.searchsorted(self.keys, grams)
            for position in np.flatnonzero(self.keys[np.minimum(near, len(self.keys) - 1)] == grams).tolist():
                for item, passage in self.exact[int(grams[position])]:
                    if item in items and tuple(words[position : position + self.passage]) == passage:
                        hits[item] = hits.get(item, 0) + 1
            out += [(index, item, n) for item, n in sorted(hits.items())]
        return out


_INDEXES: dict = {}


def _digest(block: list[tuple[int, str]]) -> str:
    """What a block holds, so that no worker takes another block's index for its own."""
    made = hashlib.sha256()
    for key, text in block:
        made.update(f"{key}:{len(text)}:{text}\n".encode("utf-8", "surrogatepass"))
    return made.hexdigest()


def _index(shared, passage: int, shingle: int, miss: float) -> PassageIndex:
    """The index of a broadcast block, built once in each worker process."""
    key = (shared.value[0], passage, shingle, miss)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = PassageIndex(shared.value[1], passage, shingle, miss)
    return _INDEXES[key]


def find_leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str,
               passage: int = 18, shingle: int = 5, miss: float = 1e-6, block_bytes: int = 4_000_000) -> DataFrame:
    """(key, item_key, passages) of every document and every item a passage of which it holds."""
    spark = documents.sparkSession
    ship(spark)
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{item_key}` bigint, passages int"
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for row in items.select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null").orderBy("k", "t").toLocalIterator():
        if held + len(row.t) * 4 > block_bytes and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((row.k, row.t))
        held += len(row.t) * 4
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast((_digest(block), block))

        def search(batches, shared=shared):
            for pdf in batches:
                rows = _index(shared, passage, shingle, miss).search(pdf["_text"].tolist())
                at = [r[0] for r in rows]
                yield pd.DataFrame({key: pdf[key].iloc[at].to_numpy(), item_key: [r[1] for r in rows], "passages": [r[2] for r in rows]}).astype({item_key: "int64", "passages": "int32"})

        found = documents.select(key, F.col(text).alias("_text")).where("_text is not null").mapInPandas(search, schema)
        out = found if out is None else out.unionAll(found)
    return out
