"""Character shingles and their sketches, for a whole Arrow batch at once in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of three characters of all texts, packed without loss into 63 bits, and
    the text of each, in order. A shorter text is one run; an empty one has none."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    at = np.flatnonzero(owner[:-2] == owner[2:]) if len(codes) > 2 else np.empty(0, np.int64)
    grams = codes[at] << _U(42) | codes[at + 1] << _U(21) | codes[at + 2]
    whose = owner[at]
    if len(short := np.flatnonzero((lengths > 0) & (lengths < 3))):
        ends = np.cumsum(lengths)[short]
        first = codes[ends - lengths[short]]
        tail = np.where(lengths[short] == 2, codes[ends - 1] + _U(1), _U(0))
        grams = np.concatenate([grams, _U(1 << 63) | first << _U(21) | tail])
        whose = np.concatenate([whose, short])
        order = np.argsort(whose, kind="stable")
        grams, whose = grams[order], whose[order]
    return grams, whose


def fast_sketch(grams: np.ndarray, owner: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

    Rounds of hashed bin placement: in each of the first ``size`` rounds every element
    falls into a random bin, in the next ``size`` rounds all fall into one fixed bin, so
    every coordinate fills. A bin keeps the least value of the first round that reaches
    it; a text leaves once all its bins are full. Two texts agree in a coordinate with
    the probability of their Jaccard similarity, with concentration as of independent
    samples.
    """
    sketch = np.full(docs * size, _EMPTY)
    full = np.zeros(docs * size, bool)
    x, base = mix(grams), owner * size
    for i in range(2 * size):
        if not len(x):
            break
        g = (x ^ _U((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)) * _U(0xD6E8FEB86659FD93)
        g ^= g >> _U(32)
        g *= _U(0xFF51AFD7ED558CCD)
        g ^= g >> _U(29)
        flat = base + ((g & _U(0xFFFFFFFF)) * _U(size) >> _U(32)).astype(np.int64) if i < size else base + (i - size)
        open_ = ~full[flat]
        flat, g = flat[open_], g[open_]
        np.minimum.at(sketch, flat, g)
        full[flat] = True
        if i >= 4 and i % 2 == 0:
            stay = ~full.reshape(docs, size).all(1)[base // size]
            x, base = x[stay], base[stay]
    return sketch.reshape(docs, size)


def minwise(grams: np.ndarray, owner: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Minwise hashing: for each of ``size`` hash functions the least value of each text."""
    rng = np.random.default_rng(20170217)
    flip, odd = rng.integers(0, 1 << 32, size, np.uint32), rng.integers(0, 1 << 32, size, np.uint32) | np.uint32(1)
    out = np.zeros((size, docs), np.uint32)
    if len(grams):
        x = mix(grams)
        x = (x ^ (x >> _U(32))).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        have = owner[starts]
        for lo in range(0, len(starts), 256):  # a block fits the cache
            s = starts[lo : lo + 256]
            end = starts[lo + 256] if lo + 256 < len(starts) else len(x)
            part, s, to = x[s[0] : end], s - s[0], have[lo : lo + 256]
            for k in range(size):
                v = (part ^ flip[k]) * odd[k]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x2C1B3C6D)
                out[k, to] = np.minimum.reduceat(v, s)
    return out.T.astype(_U)


def band_keys(sketch: np.ndarray, rows: int, salt: np.ndarray) -> np.ndarray:
    """(texts, bands): one 64-bit key for each run of ``rows`` coordinates; texts of
    another salt or bands of another number never share a key."""
    docs, size = sketch.shape
    cut = sketch[:, : size // rows * rows].reshape(docs, -1, rows)
    key = mix(salt.astype(_U))[:, None] + mix(np.arange(cut.shape[1], dtype=_U) + _U(77))[None, :]
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + cut[:, :, j])
    return key


def likeness(a: str, b: str) -> float:
    """Jaccard similarity of the sets of runs of three characters."""
    x, y = gram_set(a), gram_set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def gram_set(t: str) -> set[str]:
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()
