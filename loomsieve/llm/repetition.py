"""Share of repeated content inside one text (problem 1).

Rolling hashes of several n-gram lengths, from the same prefix sums, over all texts of
an Arrow batch at once in numpy: a position is repeated if the n-gram that starts there started earlier in the
same text; coverage counts characters inside repeated n-grams. Equal hashes are
confirmed on the characters. Lines that came before are counted too.

Null and empty texts have share 0 of 0 characters. A text shorter than n has no
n-gram of that length. Texts are handled whole; the cost is linear but for one sort.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram lengths, in characters of the letters-and-digits form.
LENGTHS = (8, 16, 32)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _word_chars() -> np.ndarray:
    """True for code points of letters and digits."""
    return np.fromiter((unicodedata.category(chr(o))[0] in "LN" for o in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the text of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(texts), dtype=np.int64), lengths)


def _rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the characters' numbers times powers of a base up to each place, and the
    inverse powers: the hash of any run is one difference, moved to the origin."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * _P
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(codes) - 1), b, np.uint64)]) for b in (_P, _P_INVERSE))
    return np.r_[np.uint64(0), np.cumsum(x * power[: len(x)])], back


def _covered(codes: np.ndarray, owner: np.ndarray, n: int, rolling: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """True for characters inside an n-gram that began earlier in the same text."""
    size = len(codes)
    mark = np.zeros(size + 1, np.int32)
    if size >= n:
        sums, back = rolling
        at = np.flatnonzero(owner[: size - n + 1] == owner[n - 1 :])
        h = (sums[at + n] - sums[at]) * back[at]
        # the owner goes into the key, so one sort serves the batch
        key = (h ^ (h >> np.uint64(31))) + (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        later, earlier = at[order[1:][same]], at[order[:-1][same]]
        if len(later):  # equal hashes of different grams would be taken out here
            sure = owner[later] == owner[earlier]
            for j in range(n):
                sure &= codes[later + j] == codes[earlier + j]
            later = later[sure]
        mark[later] += 1
        mark[later + n] -= 1
    return np.cumsum(mark[:-1]) > 0


def repetition_of(texts: list[str | None]) -> dict[str, np.ndarray]:
    """chars, share_n for each length, lines and line_share of each text."""
    given = [t or "" for t in texts]
    codes, owner = _codes([t.lower() for t in given])
    keep = _word_chars()[codes]
    codes, owner = codes[keep], owner[keep]
    chars = np.bincount(owner, minlength=len(given))
    out: dict[str, np.ndarray] = {"chars": chars}
    rolling = _rolling(codes)
    for n in LENGTHS:
        covered = np.bincount(owner, weights=_covered(codes, owner, n, rolling), minlength=len(given))
        out[f"share_{n}"] = covered / np.maximum(chars, 1)
    lines, repeated = np.zeros(len(given)), np.zeros(len(given))
    for i, t in enumerate(given):
        if "\n" in t:
            said = [x for x in (line.strip() for line in t.split("\n")) if x]
            seen: set[str] = set()
            lines[i] = sum(map(len, said))
            repeated[i] = sum(len(x) for x in said if x in seen or seen.add(x))  # type: ignore[func-returns-value]
    out["line_share"] = repeated / np.maximum(lines, 1)
    return out


def repetition_coverage(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Operator: (id, chars, share_8, share_16, share_32, line_share), a row per row.

    No shuffle: every text is measured where it is read. Rows with a null id or text
    stay (share 0); repeated ids give repeated rows.
    """

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = repetition_of(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(r[k].astype(t)) for k, t in kinds)], names=["id", *(k for k, _ in kinds)])

    kinds = [("chars", np.int64), *((f"share_{n}", np.float64) for n in LENGTHS), ("line_share", np.float64)]
    schema = "id long, chars long, " + ", ".join(f"{k} double" for k, _ in kinds[1:])
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(measure, schema)
