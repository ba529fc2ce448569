"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter; it is read where the executors run and never
copied. A text's specials are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level vocabulary for many languages, as ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, *keep, tokens), a row for each row; null texts have no tokens. No shuffle."""
    keep = keep or []

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary  # type: ignore[attr-defined]
        for b in batches:
            sizes: dict[str, int] = {}
            out = []
            for t in b["text"].to_pylist():
                n = sizes.get(t)
                if n is None:
                    n = sizes[t] = len(encode(t)) if t else 0
                out.append(n)
            yield pa.RecordBatch.from_arrays([b["id"], *(b[k] for k in keep), pa.array(out, pa.int64())], names=["id", *keep, "tokens"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{k}`").alias(k) for k in keep), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(count, ", ".join(["id long", *(f"`{k}` {kinds[k]}" for k in keep), "tokens long"]))
