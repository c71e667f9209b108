"""Spellings of publishers typed by people, linked where they mean the same one.

What a name is made of is learned from the names themselves. A spelling is a bag of folded
words. Words that can be left out (legal forms, bylines, editions) are those that the names
do without: for most names that hold one, the same name without it is there as well. Every
word's count over all names tells a slip of the pen from another word. The words that remain
become a weighted vector of character n-grams, each word's for itself, so that their order does
not matter; a distributed sparse join finds all pairs with a cosine at or above ``threshold``:
each two blocks of vectors meet in one task, which sums up the products of their common n-grams,
and only near pairs leave it. ``top_n`` may keep each name's nearest partners only.

A near pair is kept if its words can be laid side by side: equal, one slip apart, clipped or
thinned out ("Wkly", "Journ."), an initial, several initials in one word ("WJ"), or, by the optional
``hints``, a nickname. A word that finds no partner sets the pair apart. Average linkage groups the pairs:
in each round every two clusters that are each other's nearest merge, which gives the same
grouping as merging one pair at a time, without gathering any component in one place.
Spellings with bare initials join a group of whole names only if it is the only one they fit.

Defined results: null and blank names belong to no group; spellings that differ in case
or spaces only are different strings of one group; an initial that several people of one
surname share links to none of them; repeated rows change nothing; empty tables give
empty results; only the name columns are read.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.shared import discard, materialize, ship

# Nicknames of given names, by given name.
NICKNAMES = {
    "alexander": "alex alec al sandy sasha xander", "alexandra": "alexa sandra", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny",
    "barbara": "barb babs", "catherine": "cathy cate", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "eleanor": "nell ellie", "elizabeth": "liz lizzie beth betty eliza",
    "francisco": "paco pancho curro", "frederick": "fred freddy", "gregory": "greg", "giuseppe": "beppe peppe pino", "henry": "harry hank", "ignacio": "nacho",
    "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon jonny",
    "jose": "pepe", "joseph": "joe joey", "judith": "judy", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo len",
    "maria": "masha mitzi", "margaret": "maggie peggy meg marge", "matthew": "matt", "michael": "mike mick mickey", "mikhail": "misha", "nicholas": "nick nicky nico nicolas",
    "nikolai": "kolya", "olga": "olya", "pamela": "pam", "patricia": "pat patty trish", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick rich",
    "robert": "bob bobby rob bert robbie", "ronald": "ron", "samuel": "sam sammy", "sebastian": "basti seb", "sergei": "seryozha", "stephen": "steve", "steven": "stevie",
    "susan": "sue susie suzy", "tatiana": "tanya", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "ursula": "uschi ulla ursel", "victoria": "vicky tori vicki",
    "vladimir": "volodya vova", "walter": "walt wally", "wilhelm": "willi", "william": "bill billy will liam", "yekaterina": "katya", "zachary": "zach",
}


def hints_of(nicknames: dict[str, str]) -> dict[str, frozenset[str]]:
    """Given names that a word can stand for; a nickname of several stands for each."""
    out: dict[str, set] = {}
    for given, names in nicknames.items():
        for n in [given, *names.split()]:
            out.setdefault(n, set()).add(given)
    return {n: frozenset(g) for n, g in out.items()}


HINTS = hints_of(NICKNAMES)


def _same_given(hints: dict[str, frozenset[str]], givens: frozenset[str]) -> list[tuple[str, frozenset[str]]]:
    return [(n, gs) for n, gs in hints.items() if gs & givens]


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def fold(text: str) -> str:
    """Case, accents and invisible characters folded away."""
    kept = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in kept if unicodedata.category(c) not in ("Mn", "Cf"))


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*[.'’]?")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")


def words_of(name: str) -> list[tuple[str, bool, bool]]:
    """(folded word, marked as clipped by a dot or apostrophe, capitals only among other words) of a spelling, in order."""
    text = unicodedata.normalize("NFKC", name).strip()
    shouting = text.upper() == text
    if " " not in text:
        text = _CAMEL.sub(" ", text)
    out = []
    for raw in _WORD.findall(text):
        word = "".join(c for c in fold(raw) if c.isalnum())
        if word:
            capitals = not shouting and 2 <= len(word) <= 4 and raw.isalpha() and raw.isupper()
            out.append((word, not raw[-1].isalnum() or "'" in raw or "’" in raw, capitals))
    return out


def _shortens(short: str, word: str, marked: bool) -> float:
    """How well a shorter word can stand for a longer one: clipped after its beginning, or thinned out."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return 0.0
    if word.startswith(short):
        return 0.95 if marked else 0.9 if len(short) >= 3 and len(word) - len(short) >= 2 else 0.0
    at = iter(word)
    if len(short) > 6 or not all(c in at for c in short):
        return 0.0
    # thinning takes vowels out: what is left between the ends has hardly any
    inner = short[2 if short[1] == word[1] else 1 : -1]
    return 0.85 if not set(inner) & set("aeiou") and (marked or len(short) >= 3 or short[-1] == word[-1]) else 0.0


def word_likeness(a: tuple, b: tuple, hints: dict[str, frozenset[str]]) -> float:
    """From 0 to 1 of two words (text, marked, capitals, count); initials are below 0.85."""
    x, y = a[0], b[0]
    if x == y:
        return 1.0
    known, others = hints.get(x), hints.get(y)
    if known and others and known & others:
        return 0.95
    if (known is None) != (others is None):
        token, givens = (y, known) if known else (x, others)
        if len(token) >= 5 and any(edits(token, n, 1) == 1 for n, gs in _same_given(hints, givens) if len(n) >= 5):
            return 0.85
    if len(x) == 1 or len(y) == 1:
        short, long = (x, y) if len(x) == 1 else (y, x)
        return 0.8 if len(long) > 1 and short in {long[0]} | {g[0] for g in hints.get(long, ())} else 0.0
    short, long = (a, b) if len(x) < len(y) else (b, a)
    best = _shortens(short[0], long[0], short[1])
    # both usual: two words; a slip is much rarer than the word it was meant to be
    rare, usual = sorted((a[3], b[3]))
    if rare <= 3 or rare * 10 <= usual:
        size = min(len(x), len(y))
        if max(len(x), len(y)) >= 4 and (size >= 6 or x[0] == y[0]):
            apart = edits(x, y, 2)
            best = max(best, 0.9 if apart == 1 else 0.75 if apart == 2 and size >= 9 else 0.0)
    return best


def _places(words: list[tuple]) -> list[int]:
    """Place of each word among those beside the rarest one, which itself has none."""
    anchor = min((k for k, w in enumerate(words) if len(w[0]) > 1), key=lambda k: (words[k][3], -len(words[k][0]), k), default=-1)
    at = iter(range(len(words)))
    return [-1 if k == anchor else next(at) for k in range(len(words))]


def likeness(a: list[tuple], b: list[tuple], hints: dict[str, frozenset[str]] = HINTS) -> float:
    """From 0 (different publishers) to 1 of two names' words (text, marked, capitals, count).

    Words are laid side by side, best pairs first; each must find its partner, but for single
    letters beyond two pairs (middle initials) on one side only.
    """
    if not a or not b:
        return 0.0
    if "".join(w[0] for w in a) == "".join(w[0] for w in b):
        return 1.0
    place, other = _places(a), _places(b)
    scored = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            # an initial stands for the given name only where it comes first, and for an initial in its own place
            single = (len(x[0]) == 1, len(y[0]) == 1)
            if place[i] == other[j] if all(single) else (place[i] == 0 if single[0] else other[j] == 0) if any(single) else True:
                s = word_likeness(x, y, hints)
                if s:
                    scored.append((s, i, j))
    scored.sort(key=lambda t: (-t[0], t[1], t[2]))
    left, right, pairs = set(range(len(a))), set(range(len(b))), []
    for s, i, j in scored:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            pairs.append((s, a[i], b[j]))
    for mine, others, words, rest in ((left, right, a, b), (right, left, b, a)):
        if len(mine) == 1 and len(others) > 1 and words[k := next(iter(mine))][2] and sorted(words[k][0]) == sorted(rest[j][0][0] for j in others):
            pairs.append((0.9, words[k], max((rest[j] for j in others), key=lambda w: -w[3])))
            mine.clear()
            others.clear()
    loose = [a[i] for i in left] + [b[j] for j in right]
    if loose and ((left and right) or len(pairs) < 2 or any(len(w[0]) > 1 for w in loose)):
        return 0.0
    weight = [1 / math.log(2 + min(x[3], y[3])) for _, x, y in pairs]
    # the words that tell most are no mere initials
    if pairs[max(range(len(pairs)), key=lambda k: weight[k] if pairs[k][0] >= 0.85 else -1)][0] < 0.85:
        return 0.0
    return sum(w * s for w, (s, _, _) in zip(weight, pairs, strict=True)) / sum(weight)


def _bare(words: list[tuple]) -> bool:
    """Whether a name has nothing but initials beside its rarest word."""
    others = [w for w, place in zip(words, _places(words), strict=True) if place >= 0]
    return bool(others) and all(len(w[0]) == 1 or w[2] for w in others)


def _parsed(text: str) -> list[tuple]:
    return [(t, m == "1", c == "1", int(n)) for t, m, c, n in (w.split(":") for w in text.split())]


def read_names(df: DataFrame, column: str) -> DataFrame:
    """(name, words) of the distinct non-blank strings of a column."""
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<text:string,marked:boolean,capitals:boolean>>")
    def read(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [dict(zip(("text", "marked", "capitals"), w, strict=True)) for w in words_of(n)])

    names = df.select(F.col(column).alias("name")).where("trim(name) <> ''").distinct()
    # kept above the aggregate: a filter on its result would else be pushed below and read every row's name
    return names.select("name", read.asNondeterministic()("name").alias("words")).where("size(words) > 0")


def _phrases(texts: str) -> Column:
    """Phrases that a name may do without, with the bag of words that is left and their places: one or two words in a row, the first with the last ones."""
    size = F.size(texts)
    kept = lambda at, k: F.array_join(F.array_sort(F.concat(F.slice(texts, F.lit(1), at - 1), F.slice(texts, at + k, size))), " ")

    def spot(k: int):
        return lambda at: F.struct(F.array_join(F.slice(texts, at, k), " ").alias("phrase"), kept(at, k).alias("rest"), F.sequence(at, at + k - 1).alias("spots"))

    runs = []
    for k in (1, 2):
        runs.append(F.when(size > k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - k + 1)), spot(k))).otherwise(F.array().cast(_PHRASE)))
        tail = F.slice(texts, F.greatest(F.lit(1), size - k + 1), k)
        frame = F.struct(
            F.concat_ws(" … ", F.get(texts, F.lit(0)), F.array_join(tail, " ")).alias("phrase"), F.array_join(F.array_sort(F.slice(texts, F.lit(2), F.greatest(F.lit(0), size - k - 1))), " ").alias("rest"),
            F.concat(F.array(F.lit(1)), F.sequence(F.greatest(F.lit(1), size - k + 1), size)).alias("spots"),
        )
        runs.append(F.when(size > k + 1, F.array(frame)).otherwise(F.array().cast(_PHRASE)))
    return F.concat(*runs)


_PHRASE = "array<struct<phrase:string,rest:string,spots:array<int>>>"


def dispensable(names: DataFrame, share: float = 0.15, least: int = 2) -> DataFrame:
    """(phrase, n, n_without): phrases of the names (name, texts) that a name does without often enough.

    A phrase of ``n`` names is one if at least ``share`` of them, and ``least``, stand without it as well.
    """
    offered = names.select("name", F.explode(_phrases("texts")).alias("p")).select("name", "p.phrase", "p.rest").where("rest <> '' and length(phrase) > 1")
    bags = names.select(F.array_join(F.array_sort("texts"), " ").alias("bag")).distinct()
    sums = offered.join(bags, F.col("rest") == F.col("bag"), "left").groupBy("phrase").agg(F.count("*").alias("n"), F.count("bag").alias("n_without"))
    return sums.where((F.col("n_without") >= least) & (F.col("n_without") >= share * F.col("n")))


def name_cores(names: DataFrame) -> DataFrame:
    """(name, core): of each name the words that it can't do without, each as text:marked:capitals:count over all names."""
    listed = names.withColumn("texts", F.transform("words", lambda w: w["text"]))
    phrases = dispensable(listed).select("phrase")
    spots = listed.select("name", F.explode(_phrases("texts")).alias("p")).select("name", "p.phrase", "p.spots").join(phrases, "phrase")
    dropped = spots.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("spots"))).alias("dropped"))  # as long as the name
    kept = F.filter("words", lambda w, i: ~F.array_contains("dropped", i + 1))
    words = listed.join(dropped, "name", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    words = words.select("name", F.when(F.size(kept) > 0, kept).otherwise(F.col("words")).alias("words"))
    tokens = words.select("name", F.posexplode("words").alias("at", "w"))
    counts = tokens.select("name", F.col("w.text").alias("text")).distinct().groupBy("text").agg(F.count("*").alias("n"))
    flag = lambda c: F.col(f"w.{c}").cast("int").cast("string")
    spelled = tokens.withColumn("text", F.col("w.text")).join(counts, "text").select("name", "at", F.concat_ws(":", "text", flag("marked"), flag("capitals"), F.col("n").cast("string")).alias("word"))
    listed = F.array_sort(F.collect_list(F.struct("at", "word")))
    return spelled.groupBy("name").agg(F.array_join(F.transform(listed, lambda x: x["word"]), " ").alias("core"))


def _grams(core: str) -> Column:
    """Padded bigrams and trigrams of each word of a core."""

    def of(word: Column) -> Column:
        text = F.concat(F.lit("^"), F.substring_index(word, ":", 1), F.lit("$"))
        size = F.char_length(text)
        cut = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.concat(cut(2), cut(3))

    return F.flatten(F.transform(F.split(core, " "), of))


def _cosines(left: tuple, right: tuple, threshold: float, cells: int = 1 << 20, products: int = 1 << 21) -> Iterator[tuple]:
    """(i, j, cosine) arrays of the pairs at or above the threshold; a side is (offsets, n-grams, weights) of its vectors.

    Bounded memory: so many pairs and so many products of weights at a time.
    """
    (starts, grams, weights), (offsets, others, factors) = left, right
    n, size = len(starts) - 1, int(max(grams.max(initial=-1), others.max(initial=-1))) + 1
    # the left side by n-gram
    order = np.argsort(grams, kind="stable")
    rows, weights = np.repeat(np.arange(n), np.diff(starts))[order], weights[order]
    held = np.bincount(grams, minlength=size)
    begin = np.cumsum(held) - held
    step = max(1, cells // max(n, 1))
    for low in range(0, len(offsets) - 1, step):
        high = min(low + step, len(offsets) - 1)
        at = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        own = slice(offsets[low], offsets[high])
        gram, factor = others[own], factors[own]
        met = held[gram]
        total, sums, first = np.cumsum(met), np.zeros((high - low) * n), 0
        while first < len(gram):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + products, "right")))
            k = met[first:last]
            spots = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[gram[first:last]], k)
            sums += np.bincount(np.repeat(at[first:last] * n, k) + rows[spots], weights[spots] * np.repeat(factor[first:last], k), minlength=len(sums))
            first = last
        near = np.flatnonzero(sums >= threshold)
        yield near % n, low + near // n, sums[near]


_SLOTS = 8
_NO_BITS = np.uint64(0)


def _bits(chars: Iterable[str]) -> int:
    return functools.reduce(lambda m, c: m | 1 << (ord(c) & 63), chars, 0)


class _Words:
    """What quickly tells names apart: of each word its letters, length, count and the given names it may stand for."""

    def __init__(self, cores: list[str], hints: dict[str, frozenset[str]]) -> None:
        ids: dict[str, int] = {}
        rows = [[ids.setdefault(w, len(ids)) for w in c.split()] for c in cores]
        words = [_parsed(w)[0] for w in ids]
        self.many = np.array([len(r) > _SLOTS for r in rows], bool)
        self.slots = np.full((len(rows), min(_SLOTS, max(map(len, rows), default=0))), -1)
        for k, r in enumerate(rows):
            self.slots[k, : len(r[:_SLOTS])] = r[:_SLOTS]
        self.joined = np.array([hash("".join(words[w][0] for w in r)) for r in rows], np.int64)
        self.text = np.array([hash(w[0]) for w in words], np.int64)
        self.size = np.array([len(w[0]) for w in words], np.int64)
        self.first = np.array([ord(w[0][0]) for w in words], np.int64)
        self.capitals = np.array([w[2] for w in words], bool)
        self.n = np.array([w[3] for w in words], np.int64)
        self.letters = np.array([_bits(w[0]) for w in words], np.uint64)
        self.head = np.array([_bits(w[0][0]) for w in words], np.uint64)
        self.initials = np.array([_bits([w[0][0], *(g[0] for g in hints.get(w[0], ()))]) for w in words], np.uint64)
        givens = {g: 1 << (k & 63) for k, g in enumerate(sorted(set().union(*hints.values())))}
        mask = lambda gs: functools.reduce(lambda m, g: m | givens[g], gs, 0)
        self.given = np.array([mask(hints.get(w[0], ())) for w in words], np.uint64)
        self.slip = np.zeros(len(words), np.uint64)
        for name, gs in hints.items():
            if len(name) >= 5:
                apart = np.bitwise_count(self.letters ^ np.uint64(_bits(name)))
                self.slip[(self.size >= 5) & (self.given == 0) & (abs(self.size - len(name)) <= 1) & (apart <= 2)] |= np.uint64(mask(gs))


def _may_partner(a: _Words, x: np.ndarray, b: _Words, y: np.ndarray) -> np.ndarray:
    """Whether words x and y may be laid side by side: true wherever they can, as each test is looser than ``likeness``'s."""
    least, most = np.minimum(a.size[x], b.size[y]), np.maximum(a.size[x], b.size[y])
    same, short = a.first[x] == b.first[y], a.size[x] < b.size[y]
    mine, others = a.letters[x], b.letters[y]
    apart, differ = most - least, np.bitwise_count(mine ^ others)
    rare, usual = np.minimum(a.n[x], b.n[y]), np.maximum(a.n[x], b.n[y])
    # an edit changes two letters of the sets at most
    slips = (most >= 4) & ((least >= 6) | same) & (((apart <= 1) & (differ <= 2)) | ((least >= 9) & (apart <= 2) & (differ <= 4))) & ((rare <= 3) | (rare * 10 <= usual))
    shortens = same & (least >= 2) & (apart > 0) & (np.where(short, mine & ~others, others & ~mine) == _NO_BITS)
    given = (a.given[x] & (b.given[y] | b.slip[y])) | (a.slip[x] & b.given[y])
    single = ((a.size[x] == 1) & ((mine & b.initials[y]) != _NO_BITS)) | ((b.size[y] == 1) & ((others & a.initials[x]) != _NO_BITS))
    stands = (a.capitals[x] & ((mine & b.head[y]) != _NO_BITS)) | (b.capitals[y] & ((others & a.head[x]) != _NO_BITS))
    return (a.text[x] == b.text[y]) | slips | shortens | (given != _NO_BITS) | single | stands


def _may_mean_one(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """False where a word of two letters or more of names i and j has no partner, so that their likeness is 0."""
    mine, others = np.ones(len(i), bool), np.ones(len(i), bool)
    if a.slots.shape[1] and b.slots.shape[1]:
        found = np.zeros((b.slots.shape[1], len(i)), bool)
        for p in range(a.slots.shape[1]):
            x = a.slots[i, p]
            any_of = np.zeros(len(i), bool)
            for q in range(b.slots.shape[1]):
                y = b.slots[j, q]
                both = np.flatnonzero((x >= 0) & (y >= 0))
                fit = both[_may_partner(a, x[both], b, y[both])]
                any_of[fit] = found[q, fit] = True
            mine &= any_of | (x < 0) | (a.size[x] == 1)
        for q in range(b.slots.shape[1]):
            y = b.slots[j, q]
            others &= found[q] | (y < 0) | (b.size[y] == 1)
    return (mine & others) | a.many[i] | b.many[j] | (a.joined[i] == b.joined[j])


def _block_pairs(unit: DataFrame, threshold: float, blocks: int, hints: dict[str, frozenset[str]] | None) -> DataFrame:
    """(a, b, cosine) of all near pairs of vectors: each two blocks of them meet in one task, and only what is near leaves it."""
    i, j, same, block = F.least("block", "other"), F.greatest("block", "other"), F.col("block") == F.col("other"), F.pmod(F.xxhash64("core"), F.lit(blocks)).cast("int")
    sent = unit.select("core", "grams", "weights", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(i.alias("i"), j.alias("j"), same.alias("same"), (F.col("block") == i).alias("first"), "core", "grams", "weights").repartition(blocks * (blocks + 1) // 2, "i", "j")

    def meet(table: pa.Table) -> pa.Table:
        one = table["same"][0].as_py()
        sides = [table] if one else [table.filter(table["first"]), table.filter(pc.invert(table["first"]))]
        known = pc.unique(pa.chunked_array([c for t in sides for c in pc.list_flatten(t["grams"]).chunks]))
        read = []
        for t in sides:
            flat = pc.index_in(pc.list_flatten(t["grams"]), value_set=known).to_numpy().astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(t["grams"]).to_numpy())]).astype(np.int64)
            cores = t["core"].to_pylist()
            read.append(((offsets, flat, pc.list_flatten(t["weights"]).to_numpy()), cores, None if hints is None else _Words(cores, hints)))
        (left, mine, first), (right, others, second) = read[0], read[-1]
        found: tuple[list, list, list] = ([], [], [])
        if mine and others:
            for x, y, cosine in _cosines(left, right, threshold):
                keep = x < y if one else np.ones(len(x), bool)
                if hints is not None:
                    keep[keep] = _may_mean_one(first, x[keep], second, y[keep])
                for k in np.flatnonzero(keep):
                    a, b = mine[x[k]], others[y[k]]
                    for to, value in zip(found, (min(a, b), max(a, b), float(cosine[k])), strict=True):
                        to.append(value)
        return pa.table({"a": pa.array(found[0], pa.string()), "b": pa.array(found[1], pa.string()), "cosine": pa.array(found[2], pa.float64())})

    return sent.groupBy("i", "j").applyInArrow(meet, "a string, b string, cosine double")


def near_names(cores: DataFrame, threshold: float = 0.2, top_n: int | None = None, salt_rows: int = 16_000, hints: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(a, b, cosine) with a < b of all pairs of the distinct cores whose n-gram vectors have a cosine at or above the threshold.

    N-grams of one core only are left out, as they can meet no other and would only make slips of the pen
    look strange. Cores are hashed to blocks of about ``salt_rows``, however frequent their n-grams are; a block
    is sent once to each other one, and pairs are never shuffled. With ``hints``, pairs that have a word without
    partner are left out at once, as their likeness is 0.
    """
    ship(cores.sparkSession)
    grams = cores.select("core", F.explode(_grams("core")).alias("gram")).groupBy("core", "gram").agg(F.count("*").alias("k"))
    grams = materialize(grams, "name-grams")
    total = cores.count()
    idf = F.log(1 + F.lit(float(total)) / F.col("n"))
    weights = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (idf * idf).alias("idf"))
    weighted = grams.join(weights, "gram").select("core", F.struct("gram", (F.col("k") * F.col("idf")).alias("w")).alias("g"))
    vectors = weighted.groupBy("core").agg(F.array_sort(F.collect_list("g")).alias("g"))  # as long as the name
    norm = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    unit = vectors.withColumn("norm", norm).select("core", F.col("g.gram").alias("grams"), F.transform("g.w", lambda w: w / F.col("norm")).alias("weights"))
    unit = materialize(unit, "name-vectors")
    discard(grams)
    blocks = max(math.ceil(total / salt_rows), min(8, math.ceil(total / 250)), 1)
    near = _block_pairs(unit, threshold, blocks, hints if top_n is None else None)
    if top_n is not None:
        sides = near.select(F.col("a").alias("x"), "a", "b", "cosine").unionAll(near.select(F.col("b").alias("x"), "a", "b", "cosine"))
        best = Window.partitionBy("x").orderBy(F.desc("cosine"), "a", "b")
        near = sides.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top_n).select("a", "b", "cosine").distinct()
    return near


def name_links(cores: DataFrame, threshold: float = 0.2, top_n: int | None = None, hints: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(a, b, likeness, ba, bb) with a < b of cores that may mean one publisher; ba, bb: which of them have bare initials."""
    hints = HINTS if hints is None else hints

    @F.pandas_udf("struct<likeness:double,ba:boolean,bb:boolean>")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        read = {t: _parsed(t) for t in {*a, *b}}
        bare = {t: _bare(w) for t, w in read.items()}
        return pd.DataFrame({"likeness": [float(likeness(read[x], read[y], hints)) for x, y in zip(a, b, strict=True)], "ba": a.map(bare).astype(bool), "bb": b.map(bare).astype(bool)})

    # made once for each pair: a filter on its result would else have it made again
    near = near_names(cores, threshold, top_n, hints=hints).select("a", "b", compare.asNondeterministic()("a", "b").alias("l"))
    return materialize(near.select("a", "b", "l.*").where("likeness > 0"), "name-links")


def average_linkage(links: DataFrame, least: float = 0.4) -> DataFrame:
    """(name, group_id): clusters whose mean likeness over all pairs, 0 where none is linked, is at least ``least``.

    Each round merges all pairs of clusters that are each other's best partner; ties go
    to the smaller names, so at least the best pair of all merges. Sums of likeness and
    cluster sizes are enough to go on; edges shrink from round to round, and every round
    is a table in the shared folder.
    """
    # one row per pair of clusters: a < b, sum of likeness over member pairs, sizes
    edges = materialize(links.select("a", "b", F.col("likeness").alias("s"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")), "linkage")
    names = links.select(F.col("a").alias("name")).unionAll(links.select(F.col("b").alias("name"))).distinct()
    members = materialize(names.select("name", F.col("name").alias("group_id")), "members")
    while True:
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        # a struct whose maximum is the best mean, then the smallest partner names
        good = edges.withColumn("m", F.round(mean, 9)).where(F.col("m") >= least - 1e-9)
        sides = good.select(F.col("a").alias("x"), "a", "b", "m").unionAll(good.select(F.col("b").alias("x"), "a", "b", "m"))
        best = sides.groupBy("x").agg(F.min(F.struct((-F.col("m")).alias("m"), "a", "b")).alias("p"))
        mutual = best.groupBy("p.a", "p.b").count().where("count = 2").select(F.col("b").alias("from"), F.col("a").alias("into"))
        mutual = materialize(mutual, "merges")
        if mutual.isEmpty():
            discard(edges)
            return members
        moved = members.join(mutual, members["group_id"] == mutual["from"], "left").select("name", F.coalesce("into", "group_id").alias("group_id"))
        new_members = materialize(moved, "members")
        sizes = new_members.groupBy("group_id").agg(F.count("*").alias("size"))
        step = edges.join(mutual.select(F.col("from").alias("a"), F.col("into").alias("ia")), "a", "left").join(mutual.select(F.col("from").alias("b"), F.col("into").alias("ib")), "b", "left")
        step = step.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"), "s").where("x <> y")
        step = step.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s"))
        step = step.join(sizes.select(F.col("group_id").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("group_id").alias("b"), F.col("size").alias("nb")), "b")
        new_edges = materialize(step.select("a", "b", "s", "na", "nb"), "linkage")
        discard(edges)
        edges, members = new_edges, new_members


def core_groups(links: DataFrame, least: float = 0.3) -> DataFrame:
    """(core, group_id) of linked cores: whole names by linkage, those with bare initials with the only group they fit."""
    # whole names and bare ones never meet in these links, so one linkage does for both
    linked = average_linkage(links.where("ba = bb").select("a", "b", "likeness"), least).select(F.col("name").alias("core"), "group_id")
    cross = links.where("ba and not bb").select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.where("bb and not ba").select(F.col("b").alias("x"), F.col("a").alias("y")))
    side = lambda c: linked.select(F.col("core").alias(c), F.col("group_id").alias(f"g{c}"))
    met = cross.join(side("x"), "x", "left").join(side("y"), "y", "left").select("x", F.coalesce("gx", "x").alias("gx"), F.coalesce("gy", "y").alias("gy"))
    only = met.groupBy("gx").agg(F.min("gy").alias("low"), F.max("gy").alias("high")).where("low = high").select("gx", F.col("low").alias("gy"))
    only = materialize(only, "bare-groups")
    loose = met.select("x", "gx").distinct().join(only, "gx").select(F.col("x").alias("core"), F.col("gy").alias("group_id"))
    joined = linked.join(only, linked["group_id"] == only["gx"], "left").select("core", F.coalesce("gy", "group_id").alias("group_id"))
    # a single whole name that bare ones join has no group by linkage
    return joined.unionAll(loose).unionAll(only.select(F.col("gy").alias("core"), F.col("gy").alias("group_id"))).distinct()


def publisher_groups(df: DataFrame, column: str, threshold: float = 0.2, least: float = 0.3, hints: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(name, group_id) of all spellings that share their publisher with another one; the least spelling names the group.

    Names of one core are one node, however many they are.
    """
    names = materialize(read_names(df, column), "names")
    cores = materialize(name_cores(names), "name-cores")
    discard(names)
    groups = core_groups(name_links(cores.select("core").distinct(), threshold, None, hints), least)
    rows = cores.join(groups, "core", "left").select("name", F.coalesce("group_id", "core").alias("g"))
    several = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("name").alias("group_id")).where("n > 1")
    return rows.join(several, "g").select("name", "group_id")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b) with name_a < name_b: every pair of a group's spellings."""
    a = groups.select("group_id", F.col("name").alias("name_a"))
    b = groups.select("group_id", F.col("name").alias("name_b"))
    return a.join(b, "group_id").where("name_a < name_b").select("name_a", "name_b")
