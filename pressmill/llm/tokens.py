"""Token counts by a public byte-level BPE vocabulary, sent to the executors once."""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pressmill.shared import ship

VOCABULARY = os.environ.get("PRESSMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict = {}


def vocabulary(path: str = VOCABULARY) -> tuple[str, bytes]:
    with open(path, "rb") as file:
        content = file.read()
    return hashlib.sha256(content).hexdigest(), content


def encoding(named: tuple[str, bytes]):
    """The tokenizer of a vocabulary, built once per process."""
    name, content = named
    if name not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        _ENCODINGS[name] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


@lru_cache(maxsize=8)
def longest_token(tokenizer) -> int:
    """Bytes of the vocabulary's longest token."""
    return max(len(t) for t in tokenizer.token_byte_values())


def count_tokens_udf(spark: SparkSession, path: str = VOCABULARY):
    """Arrow UDF: text -> number of tokens; null for null."""
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(shared.value).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int32")

    return count
