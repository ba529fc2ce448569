"""Candidate pairs by banded sketches, and their exact verification.

Shared by near-duplicate groups (problem 2) and cross-split overlaps (problem 5).

A text is known by the 64-bit hash of its field and bare form, made anew where a second
hash shows that two texts share it (``settled``); so exact copies are one text here.
A batch sketches a text once and packs its (band key, text) entries into one binary row
per hash partition: the exchange moves a few thousand rows of packed numbers in place of
one JVM row per text and band. Candidates are verified on whole texts.

A bucket of more than ``HOT`` texts is not paired where it is read. A key that fills a
bucket from single batches leaves it there already: all but a marker of its texts go
straight into the set of hot texts, so no task gathers a giant bucket. The hot texts of
all buckets are then joined exactly by their rarest shingles (prefix filter), which finds
every pair of theirs, links or not by sketch; no bucket is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm._pairs import met
from loomsieve.llm.sketches import band_keys, gram_set, mix, shingles
from loomsieve.storage import materialize

#: Texts of a bucket that are paired where it is read, and texts of a key in one batch
#: that make it hot there.
HOT, LOCAL = 2048, 256
#: Entries of bands that one task reads.
TASK_ENTRIES = 1_500_000
#: Cells in which shingles are counted to tell rare ones from frequent ones.
CELLS = 1 << 18
Sketcher = Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]
_ENTRY = np.dtype([("key", "u1", 5), ("side", "u1"), ("text", "<i8")])
#: Side of the marker of a key whose texts went into the hot set.
MARK = 7


def settled(units: DataFrame) -> DataFrame:
    """units (h, h2, ..) without h2, with h made anew where texts of different h2 share
    it, until none do. One aggregation of two numbers a row where none does."""
    for k in range(8):
        shared = materialize(units.groupBy("h").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo <> hi").select("h", F.lit(True).alias("two")), "shared")
        if shared.isEmpty():
            break
        units = units.join(shared, "h", "left").withColumn("h", F.when(F.col("two"), F.xxhash64("h", "h2", F.lit(k))).otherwise(F.col("h"))).drop("two")
        units = materialize(units, "units")
    return units.drop("h2")


def _bands(batches: Iterable[pa.RecordBatch], sketcher: Sketcher, bands: int, rows: int, parts: int, local: int) -> Iterator[pa.RecordBatch]:
    """(part, entries, hot) of a batch of (h, salt, side, bare); hot: packed texts."""
    for b in batches:
        h, salt, side = (b[c].to_numpy(zero_copy_only=False) for c in ("h", "salt", "side"))
        # copies in a batch are sketched once for each side
        _, first = np.unique(np.stack([h, side.astype(np.int64)], 1), axis=0, return_index=True)
        if not len(first):
            continue
        h, salt, side = h[first], salt[first], side[first]
        texts = b["bare"].take(pa.array(first)).to_pylist()
        grams, owner = shingles(texts)
        keys = band_keys(sketcher(grams, owner, len(texts), bands * rows), rows, salt).ravel()
        part = ((keys & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int32)
        entries = np.empty(keys.size, _ENTRY)
        entries["key"] = (keys >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        entries["text"], entries["side"] = np.repeat(h, bands), np.repeat(side, bands)
        both = (part.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24))
        order = np.argsort(both)
        both = both[order]
        starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        many = np.diff(np.r_[starts, len(both)]) > local
        hot = b""
        if many.any():
            firsts = order[starts[many]]
            stay = np.ones(len(both), bool)
            stay[order[np.repeat(many, np.diff(np.r_[starts, len(both)]))]] = False
            hot = np.unique(entries["text"][~stay]).tobytes()
            entries["side"][firsts] = MARK
            stay[firsts] = True
            part, entries = part[stay], entries[stay]
        order = np.argsort(part, kind="stable")  # texts stay in order within a part, which packs best
        part, entries = part[order], entries[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blobs = [x.tobytes() for x in np.split(entries, cuts[1:])]
        hots = [b""] * len(blobs)
        hots[int(h[0]) % len(blobs)] = hot
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(blobs, pa.binary()), pa.array(hots, pa.binary())], names=["part", "entries", "hot"])


def _pairs(table: pa.Table, cross: bool, most: int) -> pa.Table:
    """(hot, a, b) of one hash partition: candidates, and the texts of hot buckets one
    by one as a with hot set."""
    e = np.concatenate([np.frombuffer(x, _ENTRY) for x in table["entries"].to_pylist()])
    given = np.frombuffer(b"".join(table["hot"].to_pylist()), np.int64)
    key = np.zeros((len(e), 8), np.uint8)
    key[:, :5] = e["key"]
    key, text, side = key.view("<u8").ravel(), e["text"], e["side"]
    order = np.lexsort((side, text, key))
    key, text, side = key[order], text[order], side[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (side[1:] != side[:-1])]
    key, text, side = key[new], text[new], side[new]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    hot = (length > most) | np.logical_or.reduceat(side == MARK, start)
    run, hot = np.repeat(np.arange(len(start)), length), np.repeat(hot, length)
    hots = np.unique(np.concatenate([text[hot], given]))
    live = np.flatnonzero((np.repeat(length, length) > 1) & ~hot)
    found, d = [], 1
    while len(live):
        live = live[live + d < len(run)]
        live = live[run[live] == run[live + d]]
        i, j = (live[side[live] != side[live + d]],) * 2 if cross else (live, live)
        a, b = text[i], text[j + d]
        if cross:  # a is the text of side 0
            turn = side[i] == 1
            a, b = np.where(turn, b, a), np.where(turn, a, b)
        else:
            a, b = np.minimum(a, b), np.maximum(a, b)
        found.append(np.stack([a, b], 1))
        d += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    if not cross:
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.table({"hot": np.arange(len(pairs) + len(hots)) >= len(pairs), "a": np.r_[pairs[:, 0], hots], "b": np.r_[pairs[:, 1], hots]})


def _verified(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, bare_a, bare_b) with a likeness of at least ``least``."""
    for x in batches:
        a, b, s, t = (x[c].to_pylist() for c in ("a", "b", "bare_a", "bare_b"))
        sets: dict[str, set[str]] = {}
        keep = []
        for u, v in zip(s, t, strict=True):
            p = sets.get(u) or sets.setdefault(u, gram_set(u))
            q = sets.get(v) or sets.setdefault(v, gram_set(v))
            both = len(p & q) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
            keep.append(both >= least * (len(p) + len(q) - both))
        k = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(k)


def _distinct_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each text as numbers, and the text of each, in order."""
    grams, owner = shingles(texts)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
    return grams[new], owner[new]


def _cells(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of the texts of a task."""
    n = np.zeros(CELLS, np.int64)
    for b in batches:
        n += np.bincount(_cells(_distinct_grams(b["bare"].to_pylist())[0]), minlength=CELLS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])


def _prefixes(batches: Iterable[pa.RecordBatch], often: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """(salt, x, id, sides, size): the rarest size - ceil(least * size) + 1 shingles of
    each text. Any order of shingles that is the same everywhere loses no pair."""
    for b in batches:
        grams, owner = _distinct_grams(b["bare"].to_pylist())
        order = np.lexsort((grams, often[_cells(grams)], owner))
        grams, owner = grams[order], owner[order]
        size = np.bincount(owner, minlength=b.num_rows)
        place = np.arange(len(owner)) - np.r_[0, np.cumsum(size)[:-1]][owner]
        of = size[owner]
        keep = place < of - np.ceil(least * of - 1e-9).astype(np.int64) + 1
        grams, owner = grams[keep], owner[keep]
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays([b["salt"].take(at), pa.array(grams.view(np.int64)), b["id"].take(at), b["sides"].take(at), pa.array(size[owner].astype(np.int32))], names=["salt", "x", "id", "sides", "size"])


def _hot_candidates(texts: DataFrame, least: float, cross: bool) -> DataFrame:
    """(a, b): all pairs of the hot texts (id, salt, sides, bare) that can reach ``least``.

    Texts of that likeness share one of their prefix shingles. The driver gets counts
    of at most CELLS cells (2 MB), whatever the input.
    """
    counts = np.zeros(CELLS, np.int64)
    of = texts.select("bare").mapInArrow(_counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[of["cell"].to_numpy()] = of["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    prefix = texts.mapInArrow(lambda it: _prefixes(it, shared.value, least), "salt int, x long, id long, sides int, size int")
    prefix = materialize(prefix, "prefixes")
    sides = (F.col("a.sides").bitwiseAND(1) * F.shiftright("b.sides", 1).bitwiseAND(1)) + (F.col("b.sides").bitwiseAND(1) * F.shiftright("a.sides", 1).bitwiseAND(1)) > 0
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("a.size", "b.size") >= F.lit(least) * F.greatest("a.size", "b.size") - 1e-9)
    pairs = met(prefix, ["salt", "x"], fits & sides if cross else fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.sides").alias("p"), F.col("b.sides").alias("q")).distinct()
    if not cross:
        return pairs.select("a", "b")
    one = pairs.where(F.col("p").bitwiseAND(1) * F.shiftright("q", 1).bitwiseAND(1) > 0).select("a", "b")
    other = pairs.where(F.col("q").bitwiseAND(1) * F.shiftright("p", 1).bitwiseAND(1) > 0).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return one.union(other).union(texts.where("sides = 3").select(F.col("id").alias("a"), F.col("id").alias("b")))


def class_links(units: DataFrame, sketcher: Sketcher, *, least: float, bands: int, rows: int, cross: bool) -> DataFrame:
    """Verified links (a, b) between texts of ``units`` (h, salt, side, bare), a table
    that is read more than once. cross: only links from side 0 to side 1 (a text that is
    on both sides is linked to itself)."""
    parts, most, local = max(1, -(-units.count() * bands // TASK_ENTRIES)), HOT, LOCAL
    packed = units.select("h", "salt", "side", "bare").mapInArrow(lambda it: _bands(it, sketcher, bands, rows, parts, local), "part int, entries binary, hot binary")
    packed = packed.repartitionById(parts, "part")  # a task for each part, so tasks don't grow with the input
    found = materialize(packed.groupBy("part").applyInArrow(lambda t: _pairs(t, cross, most), "hot boolean, a long, b long"), "candidates")
    text = units.groupBy("h").agg(F.first("bare").alias("bare"))
    pairs = found.where("NOT hot").select("a", "b")
    hot = materialize(found.where("hot").select(F.col("a").alias("h")).distinct(), "hot")
    if not hot.isEmpty():
        of = units.join(hot, "h", "left_semi").groupBy("h", "salt").agg(F.first("bare").alias("bare"), F.bit_or(F.when(F.col("side") == 0, 1).otherwise(2)).alias("sides"))
        pairs = pairs.union(_hot_candidates(materialize(of.select(F.col("h").alias("id"), "salt", "sides", "bare"), "texts"), least, cross))
    pairs = pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
    pairs = pairs.join(text.select(F.col("h").alias("a"), F.col("bare").alias("bare_a")), "a").join(text.select(F.col("h").alias("b"), F.col("bare").alias("bare_b")), "b")
    return pairs.mapInArrow(lambda it: _verified(it, least), "a long, b long")
