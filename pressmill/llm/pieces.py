"""Texts over a token limit cut into overlapping pieces at natural boundaries.

Agglomerative merging: a text begins as atomic segments (sentences and lines; longer
ones are cut at clauses, then spaces, then anywhere); adjacent pairs wait in a heap, and
the weakest boundary is merged first as long as the combined size plus the overlap fits.
What remains are the strongest boundaries that the limit allows: paragraph, line,
sentence, clause, space. Each later piece starts with about ``overlap`` tokens of the
piece before it.

Defined results: null and empty texts give no piece; a text within the limit is one
piece; concatenating the pieces without their overlaps gives the text back, character
for character; no piece has more tokens than the limit; repeated rows are each cut, and
an empty table gives an empty result. Of the input only key and text are read.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.tokens import VOCABULARY, encoding, longest_token, vocabulary
from pressmill.shared import ship

PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0
_SENTENCES = re.compile(r"(?:\r?\n[ \t]*){2,}|\r\n|[\r\n]|(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])")
_CLAUSES = re.compile(r"(?<=[,;:])\s+|(?<=[，；、：])")
_SPACES = re.compile(r"\s+")


def _cuts(text: str, start: int, end: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    """(end of segment, strength of the boundary there) within text[start:end]."""
    out = []
    for m in pattern.finditer(text, start, end):
        if start < m.end() < end:
            if pattern is _SENTENCES:
                breaks = m[0].count("\n") or m[0].count("\r")
                level = PARAGRAPH if breaks > 1 else LINE if breaks else SENTENCE
            else:
                level = CLAUSE if pattern is _CLAUSES else SPACE
            out.append((m.end(), level))
    return out


def _atoms(text: str, count, most: int, longest: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, strength of the boundary at the end); none has more than ``most`` tokens."""
    out: list[tuple[int, int, int, int]] = []

    def add(start: int, end: int, level: int, patterns: tuple) -> None:
        if start == end:
            return
        size = count(text[start:end]) if end - start <= most * longest else most + 1
        if size <= most:
            out.append((start, end, size, level))
            return
        for k, pattern in enumerate(patterns):
            cuts = _cuts(text, start, end, pattern)
            if cuts:
                for stop, inner in cuts:
                    add(start, stop, inner, patterns[k + 1 :])
                    start = stop
                add(start, end, level, patterns[k + 1 :])
                return
        # no boundary of any kind: halve until it fits
        middle = start + min((end - start) // 2, 100_000)
        add(start, middle, NONE, ())
        add(middle, end, level, ())

    start = 0
    for stop, level in [*_cuts(text, 0, len(text), _SENTENCES), (len(text), PARAGRAPH)]:
        add(start, stop, level, (_CLAUSES, _SPACES))
        start = stop
    return out


def _merge(atoms: list[tuple[int, int, int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Merge weakest boundaries first; (first, last + 1) atom of each span that remains."""
    n = len(atoms)
    size = [a[2] for a in atoms]
    level = [a[3] for a in atoms]
    right = [*range(1, n), -1]
    left = [-1, *range(n - 1)]
    alive = [True] * n
    stamp = [0] * n
    heap = [(level[i], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, total, i, si, sj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or stamp[i] != si or stamp[j] != sj:
            continue
        if total + (overlap if atoms[i][0] else 0) > limit:
            continue
        size[i], level[i], right[i] = total, level[j], right[j]
        alive[j] = False
        stamp[i] += 1
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (level[i], size[i] + size[right[i]], i, stamp[i], stamp[right[i]]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (level[k], size[k] + size[i], k, stamp[k], stamp[i]))
    firsts = [i for i in range(n) if alive[i]]
    return list(zip(firsts, [*firsts[1:], n], strict=True))


def _fitting(text: str, atoms: list[tuple[int, int, int, int]], count, limit: int, overlap: int, goal: float) -> list[tuple[int, int]]:
    """Spans of new text that fit with their overlap.

    Atoms are sized one by one, and a joined text may take a token more at each seam;
    a span found too large is merged again with a smaller goal.
    """
    out = []
    for first, last in _merge(atoms, int(goal), overlap):
        start, end = atoms[first][0], atoms[last - 1][1]
        if last - first == 1 or count(text[start:end]) + (overlap if start else 0) <= limit:
            out.append((start, end))
        else:
            out += _fitting(text, atoms[first:last], count, limit, overlap, goal * 0.8)
    return out


def _overlap_start(text: str, low: int, start: int, tokenizer, overlap: int) -> int:
    """Where to begin so that about ``overlap`` tokens of text[low:start] are repeated, at a word if one begins near."""
    back = overlap * 12
    while True:  # until there are tokens enough, however long they are
        reach = max(low, start - back)
        tokens = tokenizer.encode_ordinary(text[reach:start])
        if len(tokens) > overlap:
            break
        if reach == low:
            return low
        back *= 2
    tail = b"".join(tokenizer.decode_single_token_bytes(t) for t in tokens[-overlap:])
    begin = start - len(tail.decode("utf-8", "ignore"))
    near = _SPACES.search(text, begin, min(start, begin + 40))
    return near.end() if near and near.end() < start else begin


def split_text(text: str, tokenizer, limit: int = 1500, overlap: int = 100) -> list[tuple[int, int, int, int]]:
    """Pieces of a text: (start with overlap, start of new text, end, tokens)."""

    def count(part: str) -> int:
        return len(tokenizer.encode_ordinary(part))

    longest = longest_token(tokenizer)
    # so many characters can't fit into the limit, since no token has more bytes than the longest
    whole = count(text) if len(text) <= limit * longest else limit + 1
    if whole <= limit:
        return [(0, 0, len(text), whole)]
    slack = max(1, limit // 50)
    spans = _fitting(text, _atoms(text, count, max(1, limit - overlap - slack), longest), count, limit, overlap, limit - slack)
    out: list[tuple[int, int, int, int]] = []
    for k, (start, end) in enumerate(spans):
        begin = _overlap_start(text, spans[k - 1][0], start, tokenizer, overlap) if k and overlap else start
        n = count(text[begin:end])
        while n > limit and begin < start:
            begin = min(start, begin + max(1, (start - begin) // 4))
            n = count(text[begin:end])
        out.append((begin, start, end, n))
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1500, overlap: int = 100, oversized_only: bool = False,
                with_text: bool = True, path: str = VOCABULARY) -> DataFrame:
    """One row per piece: key, piece (from 1), n_pieces, begin_char, new_char, end_char, n_tokens and its text.

    oversized_only leaves out texts within the limit; of those, texts of no more bytes
    than the limit need no tokenizer, since each token of a byte-level vocabulary takes
    at least one byte.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, n_pieces int, begin_char int, new_char int, end_char int, n_tokens int"
    schema += ", piece_text string" if with_text else ""
    columns = ["piece", "n_pieces", "begin_char", "new_char", "end_char", "n_tokens"]

    def cut(batches):
        tokenizer = encoding(shared.value)
        for pdf in batches:
            at, rows, parts = [], [], []
            for i, whole in enumerate(pdf["_text"]):
                pieces = split_text(whole, tokenizer, limit, overlap)
                if oversized_only and len(pieces) == 1:
                    continue
                for k, (begin, start, end, n) in enumerate(pieces, 1):
                    at.append(i)
                    rows.append((k, len(pieces), begin, start, end, n))
                    if with_text:
                        parts.append(whole[begin:end])
            out = pd.DataFrame(rows, columns=columns, dtype="int32")
            out.insert(0, key, pdf[key].iloc[at].to_numpy())
            yield out.assign(piece_text=parts) if with_text else out

    rows = df.select(key, F.col(text).alias("_text")).where("_text is not null and _text <> ''")
    if oversized_only:
        rows = rows.where(F.octet_length("_text") > limit)
    return rows.mapInPandas(cut, schema)
