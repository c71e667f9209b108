"""Pieces give the text back, keep the limit, overlap about as asked, and prefer strong boundaries."""

import random

import pytest

from pressmill.llm import pieces as P
from pressmill.llm.tokens import encoding, vocabulary

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return encoding(vocabulary())


def shapes():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(4, 20))).capitalize() + ". "
    return {
        "sentences": "".join(sentence() for _ in range(400)),
        "paragraphs": "\n\n".join(sentence().strip() for _ in range(500)),
        "crlf": "\r\n\r\n".join(sentence().strip() for _ in range(300)),
        "short lines": "\n".join(word() for _ in range(3000)),
        "short paragraphs": "\n\n".join(word() for _ in range(2500)),
        "one run": "".join(r.choice("abcdefghij") for _ in range(30_000)),
        "chinese": "。".join("贸易港口航运码头工人罢工" * r.randrange(1, 5) for _ in range(300)),
        "chinese run": "港" * 5000,
        "blanks": " \n" * 4000,
        "emoji": "🚢⚓" * 2500,
        "mixed": "Порт закрыт; 港口关闭。 Port closed, again: " * 300,
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize(("limit", "overlap"), [(1500, 100), (200, 20), (50, 0)])
def test_round_trip_limit_and_overlap(tokenizer, name, limit, overlap):
    text = shapes()[name]
    cut = P.split_text(text, tokenizer, limit, overlap)
    assert "".join(text[new:end] for _, new, end, _ in cut) == text
    for k, (begin, new, end, n) in enumerate(cut):
        assert n == len(tokenizer.encode_ordinary(text[begin:end])) <= limit
        assert begin <= new < end
        if k == 0:
            assert begin == new == 0
        elif overlap:
            assert begin >= cut[k - 1][1]  # repeats of the piece before, no further back


def test_overlap_is_about_as_asked(tokenizer):
    cut = P.split_text(shapes()["sentences"], tokenizer, 1500, 100)
    sizes = [len(tokenizer.encode_ordinary(shapes()["sentences"][b:n])) for b, n, _, _ in cut[1:]]
    assert all(60 <= s <= 110 for s in sizes)


def test_strong_boundaries_win(tokenizer):
    parts = ["word " * 300 + "end." for _ in range(6)]
    text = "\n\n".join(parts)
    cut = P.split_text(text, tokenizer, 800, 50)
    assert all(text[new - 2 : new] == "\n\n" for _, new, _, _ in cut[1:])


def test_no_better_merge_is_left(tokenizer):
    """Two neighbours that would fit together with their overlap are never left apart."""
    atoms = [(i * 10, i * 10 + 10, random.Random(i).randrange(1, 40), random.Random(i * 7).randrange(0, 6)) for i in range(200)]
    spans = P._merge(atoms, 100, 10)
    size = [sum(a[2] for a in atoms[i:j]) for i, j in spans]
    for k in range(len(spans) - 1):
        assert size[k] + size[k + 1] + (10 if k else 0) > 100


def test_frame(spark):
    texts = [(1, "short"), (2, None), (3, ""), (4, "word " * 4000), (4, "word " * 4000), (None, "x")]
    df = spark.createDataFrame([(k, t, "a", 0) for k, t in texts], "id int, text string, piece string, n_tokens int")
    rows = P.split_texts(df, "id", "text").collect()
    assert sum(r.id == 1 for r in rows) == 1 and not any(r.id in (2, 3) for r in rows)
    assert sum(r.id == 4 for r in rows) == 2 * max(r.n_pieces for r in rows if r.id == 4)
    assert {r.id for r in P.split_texts(df, "id", "text", oversized_only=True, with_text=False).collect()} == {4}
    assert P.split_texts(df.limit(0), "id", "text").count() == 0


def test_long_tokens_keep_their_overlap_and_long_texts_are_counted_exactly(tokenizer):
    from pressmill.llm.tokens import longest_token

    longest = longest_token(tokenizer)
    text = ("-" * longest + " ") * 400  # few tokens, many characters
    limit = len(tokenizer.encode_ordinary(text))
    assert len(P.split_text(text, tokenizer, limit, 20)) == 1
    cut = P.split_text(text, tokenizer, limit // 3, 40)
    assert len(cut) > 1 and all(n <= limit // 3 for *_, n in cut)
    for begin, start, _, _ in cut[1:]:
        assert 20 <= len(tokenizer.encode_ordinary(text[begin:start])) <= 60
