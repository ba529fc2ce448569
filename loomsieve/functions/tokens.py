"""Lengths in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A byte-level vocabulary for many languages, as ranks, where the executors run.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _tokenizer(path: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("lengths", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_length(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens; null for null."""

    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        encode = _tokenizer(vocabulary).encode_ordinary  # type: ignore[attr-defined]
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return length(text)
