"""Language of texts and of each segment of mixed texts, with a confidence.

Word-first backoff: a word the model knows is scored by its log frequency in each
language; an unknown lower-case word falls back to its longest known character
n-grams, then to shorter ones. Unknown capitalised words are taken for names, which
have no language. A text is cut into segments at line ends, sentence ends and headline
separators; quoted phrases and page furniture (short lines that recur on many pages)
are left out. A language belongs to a text if a whole segment is in it.

The model is fitted in the query on a bounded sample of labelled texts (``per_language``
texts of each language, ``chars_per_text`` characters of each) whose sentences agree with
function words of the label's language. Everything else covers all rows and whole texts;
furniture is counted over all of them, and is what recurs on a share of the pages.

Defined results: null, empty or wordless texts, and those in another language, get empty arrays; a label that is null,
blank or names no language is ``missing``; repeated rows are scored alike; rows and other
columns are kept as they are, and an empty table gives an empty result. An empty training
sample leaves function words and scripts to decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.functions.labels import label_language
from pressmill.shared import ship

LANGUAGES = ("english", "spanish", "german", "french", "russian", "chinese")
# Function words that start the fitting.
SEEDS = {
    "english": "the of and to in for on with was is by from at that after before while over near which as its this",
    "spanish": "el la los las de del que y en un una por con para se al tras según entre pero su más cerca",
    "german": "der die das und in den von zu mit im ein eine bei nach für auf wegen während über dem nicht ist vor",
    "french": "le la les des du de et en un une dans pour sur par au aux que après selon qui près est avec ce",
    "russian": "и в на с по из за от до у что как но не к для после рядом о об",
}
_TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?…])\s+|(?<=[。！？；])|\s[|–—/•·]+\s")
_QUOTED = re.compile(r"«[^«»\r\n]{0,300}»|“[^“”\r\n]{0,300}”|„[^„“”\r\n]{0,300}[“”]|「[^「」\r\n]{0,300}」|\"[^\"\r\n]{0,300}\"")
_FLOOR = -13.0
LEAST_KNOWN = 0.4
"""Share of known words below which a text is in none of the languages."""


def _words(segment: str) -> list[str]:
    return _TOKEN.findall(segment)


def _script(word: str) -> str | None:
    if "㐀" <= word[0] <= "鿿":
        return "chinese"
    return "russian" if "Ѐ" <= word[0] <= "ӿ" else None


@dataclass
class LanguageModel:
    words: dict[str, int]
    scores: np.ndarray  # row 0 is neutral
    grams: list[dict[str, np.ndarray]]  # longest first
    furniture: frozenset[str]
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def backoff(self, word: str) -> np.ndarray:
        """Mean log probability of the longest n-grams known, zero if none is."""
        found = self.cache.get(word)
        if found is not None:
            return found
        padded, out = f" {word.lower()} ", np.zeros(len(LANGUAGES), np.float32)
        for grams in self.grams:
            n = len(next(iter(grams))) if grams else 0
            rows = [grams[g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in grams and g != " "] if n else []
            if rows:
                out = np.mean(rows, axis=0, dtype=np.float32)
                break
        if len(self.cache) < 200_000:
            self.cache[word] = out
        return out

    def scores_of(self, text: str) -> np.ndarray | None:
        """Log score of the whole text in each language, null if no word could be scored."""
        tokens, get = _TOKEN.findall(text), self.words.get
        found = [get(t, 0) for t in tokens]
        unknown = np.zeros(len(LANGUAGES))
        n = 0
        for j, k in enumerate(found):
            if not k:
                token = tokens[j]
                if "㐀" <= token[0] <= "鿿":
                    found[j] = get("一", 0)
                elif len(token) > 2 and token[0].islower() and (row := self.backoff(token)).any():
                    unknown += row
                    n += 1
        n += len(found) - found.count(0)
        return self.scores[found].sum(axis=0, dtype=np.float64) + unknown if n else None

    def vote(self, text: str | None, most_chars: int = 24_000, least_letters: int = 100) -> tuple[list[str], float, float, float, float]:
        """Five best languages, score of the best, its margin, margin a letter, and share of the three chunks' letters that agree.

        Scores are sums of log frequencies, no probabilities of truth; a text without scored words has none (not a number).
        """
        text = (text or "")[:most_chars]
        total = self.scores_of(text)
        if total is None:
            return [], math.nan, math.nan, math.nan, 0.0
        order = np.argsort(-total, kind="stable")
        score, margin = float(total[order[0]]), float(total[order[0]] - total[order[1]])
        width = min(1200, max(200, len(text) // 3))
        votes: Counter = Counter()
        for start in sorted({0, max(0, (len(text) - width) // 2), max(0, len(text) - width)}):
            chunk = text[start : start + width]
            letters = sum(c.isalpha() for c in chunk)
            if letters >= least_letters:
                part = self.scores_of(chunk)
                votes[None if part is None else int(part.argmax())] += letters
        agreement = votes[int(order[0])] / votes.total() if votes else 0.0
        return [LANGUAGES[k] for k in order[:5]], score, margin, margin / max(1, sum(c.isalpha() for c in text)), agreement

    def segments(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: its text's index, best language, confidence, scored words, known ones among them, and unknown ones that are no names.

        Kana are counted by their characters, twice, as the words they are part of have no spaces and ideographs beside them.
        """
        owner, ids, unknown, counts, strange = [], [], [], [], []
        get = self.words.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(q in text for q in "«“„「\""):
                text = _QUOTED.sub(" ", text)
            for segment in _CUT.split(text):
                if not segment or segment.strip() in self.furniture:
                    continue
                tokens = _TOKEN.findall(segment)
                if not tokens:
                    continue
                found = [get(t, -1) for t in tokens]
                odd = 0
                if -1 in found:
                    at = len(ids)
                    for j, k in enumerate(found):
                        if k < 0:
                            found[j] = 0
                            word = tokens[j]
                            if word[0].islower():
                                odd += 1
                                if len(word) > 2:
                                    unknown.append((at + j, word))
                            elif "\u3040" <= word[0] <= "\u30ff":
                                odd += 2 * len(word)
                            elif "㐀" <= word[0] <= "鿿":
                                found[j] = get("一", 0)
                ids += found
                owner.append(i)
                counts.append(len(found))
                strange.append(odd)
        if not owner:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        index = np.asarray(ids)
        score = self.scores[index]
        scored = index > 0
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        known = np.add.reduceat(scored.astype(np.int64), starts)
        for at, word in unknown:
            row = self.backoff(word)
            score[at] = row
            scored[at] = bool(row.any())
        total = np.add.reduceat(score, starts, axis=0).astype(np.float64)
        n = np.add.reduceat(scored.astype(np.int64), starts)
        shifted = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
        weight = np.exp(shifted)
        best = weight.argmax(axis=1)
        return np.asarray(owner), best, 1 / weight.sum(axis=1), n, known, np.asarray(strange)

    def texts(self, texts: list[str | None], least_words: int = 5, least_confidence: float = 0.8, least_known: float = LEAST_KNOWN) -> list[tuple[list[str], list[float], list[int]]]:
        """Languages of each text, most words first, with confidence (word-weighted mean) and words.

        A segment speaks for its language with ``least_words`` known words; where none does, the
        best-scored language of all segments stands if at least two words were scored. A text of which fewer
        than ``least_known`` of the words that are no names are known is in none of the languages.
        """
        owner, best, confidence, n, known, strange = self.segments(texts)
        ours = np.bincount(owner, known, len(texts))
        foreign = ours < least_known * (ours + np.bincount(owner, strange, len(texts)))
        strong = (known >= least_words) & (confidence >= least_confidence)
        found: list[dict[int, list[float]]] = [{} for _ in texts]
        weak: list[dict[int, list[float]]] = [{} for _ in texts]
        for i, b, c, k, s in zip(owner.tolist(), best.tolist(), confidence.tolist(), n.tolist(), strong.tolist(), strict=True):
            if not k:
                continue
            entry = (found if s else weak)[i].setdefault(b, [0.0, 0])
            entry[0] += c * k
            entry[1] += k
        out = []
        for strongs, weaks, none in zip(found, weak, foreign.tolist(), strict=True):
            if none:
                out.append(([], [], []))
                continue
            chosen = strongs
            if not chosen and weaks:
                b = max(weaks, key=lambda x: (weaks[x][0], -x))
                chosen = {b: weaks[b]} if weaks[b][1] >= 2 else {}
            order = sorted(chosen.items(), key=lambda x: (-x[1][1], x[0]))
            out.append(([LANGUAGES[b] for b, _ in order], [v[0] / v[1] for _, v in order], [int(v[1]) for _, v in order]))
        return out


def fit(samples: list[tuple[str, str]], least_texts: int = 4, longest_gram: int = 5, furniture: frozenset[str] | None = None) -> LanguageModel:
    """Fit on (language, text) pairs, keeping sentences that agree with their label's function words; furniture not given is what recurs in three of the texts."""
    seeds = {lang: set(ws.split()) for lang, ws in SEEDS.items()}
    texts_with: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
    uses: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
    lower_seen: set[str] = set()
    lines: Counter = Counter()
    for lang, text in samples:
        lines.update({s.strip() for s in re.split(r"[\r\n]+", text) if 0 < len(s.strip()) <= 60})
        here: dict[str, set] = defaultdict(set)
        for segment in _CUT.split(_QUOTED.sub(" ", text)):
            tokens = _words(segment)
            if not tokens:
                continue
            scripts = Counter(_script(t) for t in tokens)
            guess = next((s for s in ("chinese", "russian") if scripts[s] * 2 > len(tokens)), None)
            if guess is None:
                hits = {k: sum(t.lower() in v for t in tokens) for k, v in seeds.items()}
                guess = max(hits, key=lambda k: hits[k])
                if not hits[guess] or sum(h == hits[guess] for h in hits.values()) > 1:
                    continue
            if guess != lang:
                continue
            uses[lang].update(t.lower() for t in tokens)
            here[lang].update(t.lower() for t in tokens)
            lower_seen.update(t for t in tokens if t[0].islower())
        for k, ws in here.items():
            texts_with[k].update(ws)
    kept = {w for lang in LANGUAGES for w, n in texts_with[lang].items() if n >= least_texts and (w in lower_seen or lang in ("german", "chinese"))}
    kept |= {w for ws in seeds.values() for w in ws} | {"一"}
    size = {lang: sum(n for w, n in uses[lang].items() if w in kept) + 1 for lang in LANGUAGES}
    order = sorted(kept)
    scores = np.zeros((len(order) + 1, len(LANGUAGES)), np.float32)
    words: dict[str, int] = {}
    for i, w in enumerate(order, 1):
        for k, lang in enumerate(LANGUAGES):
            n = uses[lang][w] + (5 if w in seeds.get(lang, ()) else 0) + (5 if lang == "chinese" == _script(w) else 0)
            if lang not in ("chinese", "russian") and _script(w):
                n = 0
            scores[i, k] = max(_FLOOR, math.log(n / (size[lang] + 500))) if n else _FLOOR
        for form in {w, w.capitalize(), w.upper()}:
            words.setdefault(form, i)
    grams = []
    for length in range(longest_gram, 0, -1):
        counts: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
        for lang in LANGUAGES:
            for w in kept:
                n = texts_with[lang][w]
                if n and not (_script(w) == "chinese"):
                    padded = f" {w} "
                    for i in range(len(padded) - length + 1):
                        counts[lang][padded[i : i + length]] += math.log1p(n)
        total = {lang: sum(c.values()) + 1.0 for lang, c in counts.items()}
        table = {}
        for g in set().union(*counts.values()):
            row = [math.log(counts[lang][g] / total[lang]) if counts[lang][g] else _FLOOR for lang in LANGUAGES]
            table[g] = np.asarray([max(_FLOOR, x) for x in row], np.float32)
        grams.append(table)
    return LanguageModel(words, scores, grams, frozenset(s for s, n in lines.items() if n >= 3) if furniture is None else furniture)


def recurring_lines(df: DataFrame, text: str, share: float = 0.001, least_pages: int = 3, longest: int = 60) -> frozenset[str]:
    """Short lines that stand on at least ``share`` of all pages, and on ``least_pages``, counted over whole texts.

    At most 1 / ``share`` times a page's mean number of short lines reach the driver.
    """
    at_least = max(least_pages, math.ceil(df.count() * share))
    lines = F.transform(F.split(F.col(text), r"[\r\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    short = F.array_distinct(F.filter(lines, lambda x: F.char_length(x).between(1, longest)))
    counted = df.select(F.explode(short).alias("line")).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return frozenset(row.line.strip() for row in counted.select("line").collect())


def fit_from(df: DataFrame, key: str, text: str, label: str, per_language: int = 300, chars_per_text: int = 20_000, furniture: frozenset[str] | None = None) -> LanguageModel:
    """Fit on at most ``per_language`` labelled texts of each language, chosen by the hash of their key.

    Only keys and labels are ranked; the bounded choice of texts (at most six times
    ``per_language``, each of ``chars_per_text``) is sent to the driver, and the furniture
    of all texts where it isn't given.
    """
    if furniture is None:
        furniture = recurring_lines(df, text)
    keyed = df.select(F.col(key).alias("k"), label_language(F.col(label)).alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    chosen = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("k", "lang").collect()
    languages = {row.k: row.lang for row in chosen}
    if not languages:
        return fit([], furniture=furniture)
    texts = df.where(F.col(key).isin(list(languages)) & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.substring(text, 1, chars_per_text).alias("t")).collect()
    return fit(sorted((languages[row.k], row.t) for row in texts), furniture=furniture)


RESULT = "struct<languages:array<string>,confidence:array<double>,words:array<int>>"


def language_udf(spark: SparkSession, model: LanguageModel, least_words: int = 5, least_confidence: float = 0.8):
    """Arrow UDF: text -> languages, confidence and words, most words first."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def detect(texts: pd.Series) -> pd.DataFrame:
        rows = shared.value.texts(texts.tolist(), least_words, least_confidence)
        return pd.DataFrame({"languages": [r[0] for r in rows], "confidence": [r[1] for r in rows], "words": [r[2] for r in rows]})

    return detect


VOTE = "struct<languages:array<string>,score:double,margin:double,margin_per_letter:double,agreement:double>"


def vote_udf(spark: SparkSession, model: LanguageModel):
    """Arrow UDF: text -> five best languages, score, margin, margin a letter and agreement of three chunks."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(VOTE)
    def vote(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.vote(t) for t in texts.tolist()]
        return pd.DataFrame(rows, columns=["languages", "score", "margin", "margin_per_letter", "agreement"])

    return vote


def segment_languages(df: DataFrame, text: str, model: LanguageModel, keys: list[str]) -> DataFrame:
    """One row per segment with scored words: keys, segment number, language, confidence, words."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", segment int, language string, confidence double, words int"

    def run(batches):
        for batch in batches:
            owner, best, confidence, n, *_ = shared.value.segments(batch.column(len(keys)).to_pylist())
            if not len(owner):
                continue
            first = np.r_[True, owner[1:] != owner[:-1]]
            at = np.arange(len(owner))
            place = at - np.maximum.accumulate(np.where(first, at, 0))
            keep = n > 0
            columns = [batch.column(i).take(pa.array(owner[keep])) for i in range(len(keys))]
            columns += [pa.array(place[keep].astype(np.int32)), pa.array([LANGUAGES[b] for b in best[keep]], pa.string()), pa.array(confidence[keep]), pa.array(n[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "segment", "language", "confidence", "words"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def label_cases(df: DataFrame, detected: str, label: str) -> DataFrame:
    """One row per language of each text whose label is missing or wrong or that mixes languages; adds ``language`` and ``language_confidence``."""
    named = label_language(F.col(label))
    found = F.col(f"{detected}.languages")
    case = (F.size(found) > 0) & (named.isNull() | (F.size(found) > 1) | (named != F.element_at(found, 1)))
    pairs = F.arrays_zip(found.alias("l"), F.col(f"{detected}.confidence").alias("c"))
    return df.where(case).withColumn("_pair", F.explode(pairs)).withColumn("language", F.col("_pair.l")).withColumn("language_confidence", F.col("_pair.c")).drop("_pair")
