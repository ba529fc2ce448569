"""Exact first-wins dedup, near-duplicate links, greedy survivors, stage counts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from loomsieve.functions import text as T
from loomsieve.operators.tasks import TASKS, task_text, with_clean_task
from loomsieve.storage import drop, materialize

#: Rows of a block of vectors that one task multiplies with another.
BLOCK = 2048
#: Links that one task walks at once (16 bytes each).
FEW_LINKS = 500_000
#: Permutations, and bands x rows with the least weighted error at a threshold of 0.7.
PERMUTATIONS, BANDS, ROWS = 128, 14, 9


def prepare(records: DataFrame) -> DataFrame:
    """Adds the compared text (text), its hash and its general normal form (norm)."""
    out = with_clean_task(records).withColumn("text", task_text())
    return out.withColumn("hash", T.text_hash(T.normal_hash(F.col("text")))).withColumn("norm", T.normal_general(F.col("text")))


def exact_first(prepared: DataFrame, id_col: str = "ord") -> DataFrame:
    """One row for each hash over all tasks, the one with the least id; blank texts go.

    The survivors are found by an aggregation that combines before the shuffle, so a
    hash shared by a third of the rows is one row for each map task.
    """
    rows = prepared.where(~T.is_blank(F.col("text")))
    first = rows.groupBy("hash").agg(F.min(id_col).alias(id_col))
    return rows.join(first.select(id_col), id_col, "left_semi")


def jaccard_links(df: DataFrame, id_col: str, task_col: str, text_col: str) -> DataFrame:
    """(task, a, b, jaccard), a before b: exact similarity join of word shingles within
    a task, by the n and threshold of its TaskSpec.

    Prefix filter: with shingles ordered from rare to frequent, two sets of similarity t
    share one among the first size - ceil(t * size) + 1. Frequent shingles so never
    become join keys, and no pair is lost.
    """
    spec = {t: s for t, s in TASKS.items() if s.shingle}
    n, t = (F.create_map(*(x for k, s in spec.items() for x in (F.lit(k), F.lit(getattr(s, f)))))[F.col("task")] for f in ("shingle", "jaccard"))
    sets = df.where(F.col(task_col).isin(*spec)).select(F.col(task_col).alias("task"), F.col(id_col).alias("id"), F.col(text_col).alias("x"))
    sets = T.with_tokens(sets, F.col("x")).select("task", "id", F.transform(T.word_shingles(F.col("w"), n), lambda x: F.xxhash64(x)).alias("s"), t.alias("t")).where("size(s) > 0")
    sets = materialize(sets.withColumn("s", F.array_distinct("s")), "shingles")
    each = sets.select("task", "id", F.explode("s").alias("x"))
    often = each.groupBy("task", "x").agg(F.count("*").alias("f")).where("f > 1")
    keyed = each.join(often, ["task", "x"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    # shingles of one text only can't be shared: they come first in the order, and only shorten the prefix
    small = sets.select("task", "id", "t", F.size("s").alias("size")).join(keyed, "id")
    prefix = small.select("task", "id", "t", "size", F.explode(F.slice("o", F.lit(1), F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("t") * F.col("size") - 1e-9).cast("int") + 1 - (F.col("size") - F.size("o"))))).alias("k")).select("task", "id", "t", "size", "k.x")
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("a.size", "b.size") >= F.col("a.t") * F.greatest("a.size", "b.size") - 1e-9)
    pairs = a.join(b, (F.col("a.task") == F.col("b.task")) & (F.col("a.x") == F.col("b.x")) & fits).select("a.task", "a.t", F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    of = lambda k: sets.select(F.col("id").alias(k), F.col("s").alias(f"s_{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("n", F.size(F.array_intersect("s_a", "s_b")))
    out = both.withColumn("jaccard", F.col("n") / (F.size("s_a") + F.size("s_b") - F.col("n")))
    return out.where("jaccard >= t - 1e-9").select("task", "a", "b", "jaccard")


@F.pandas_udf(ArrayType(LongType()))
def minhash_bands(shingles: pd.Series) -> pd.Series:
    """Band keys of the signature of each set of 64-bit hashes."""
    rng = np.random.default_rng(128)
    mul = rng.integers(1, 1 << 63, PERMUTATIONS, np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)

    def keys(s: np.ndarray) -> list[int]:
        x = np.asarray(s, np.int64).view(np.uint64)
        h = x[None, :] * mul[:, None] + add[:, None]
        sig = (h ^ (h >> np.uint64(31))).min(1)[: BANDS * ROWS].reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            key = (key ^ sig[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64).tolist()

    return shingles.map(keys)


def lsh_candidates(df: DataFrame, id_col: str, task_col: str, text_col: str) -> DataFrame:
    """(task, a, b): pairs of a task that share a band of their minhash signature, of
    shingles by the n of its TaskSpec (5 for a task without one)."""
    known = F.create_map(*(x for k, s in TASKS.items() if s.shingle for x in (F.lit(k), F.lit(s.shingle))))
    n = F.coalesce(known[F.col("task")], F.lit(5))
    tokens = T.with_tokens(df.select(F.col(task_col).alias("task"), F.col(id_col).alias("id"), F.col(text_col).alias("x")), F.col("x"))
    sets = tokens.select("task", "id", F.transform(T.word_shingles(F.col("w"), n), lambda x: F.xxhash64(x)).alias("s")).where("size(s) > 0")
    bands = sets.select("task", "id", F.posexplode(minhash_bands("s")).alias("band", "key"))
    bands = materialize(bands, "bands")
    bands = bands.join(bands.groupBy("task", "band", "key").count().where("count > 1"), ["task", "band", "key"], "left_semi")
    a, b = bands.alias("a"), bands.alias("b")
    on = (F.col("a.task") == F.col("b.task")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, on).select("a.task", F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def edit_links(df: DataFrame, id_col: str, text_col: str, most: int = 2) -> DataFrame:
    """(a, b, distance), a before b: texts within ``most`` edits, exactly.

    Pigeonhole: cut into most + 1 segments, a text keeps one of them whole through most
    edits, moved by at most ``most``. Segments of one side meet substrings of the other
    by an equi-join on (length, segment, string); then the distance is computed.
    """
    k = most + 1
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"), F.length(text_col).alias("n"))
    cut = lambda n, i: F.floor(n * i / k).cast("int")
    segments = texts.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), cut(F.col("n"), i).alias("at"), (cut(F.col("n"), i + 1) - cut(F.col("n"), i)).alias("len")))).alias("s"), "x")
    segments = segments.select("id", "x", F.col("n").alias("of"), "s.i", F.expr("substring(x, s.at + 1, s.len)").alias("seg"))
    probes = texts.select("id", "x", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n") + most)).alias("of"))
    probes = probes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    probes = probes.withColumn("at", cut(F.col("of"), F.col("i"))).withColumn("len", cut(F.col("of"), F.col("i") + 1) - F.col("at"))
    probes = probes.withColumn("p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - most), F.greatest(F.lit(0), F.col("at") - most, F.least(F.col("at") + most, F.col("n") - F.col("len"))))))
    probes = probes.select("id", "x", "of", "i", F.expr("substring(x, p + 1, len)").alias("seg")).distinct()
    on = (F.col("s.of") == F.col("p.of")) & (F.col("s.i") == F.col("p.i")) & (F.col("s.seg") == F.col("p.seg")) & (F.col("s.id") != F.col("p.id"))
    near = segments.alias("s").join(probes.alias("p"), on).withColumn("distance", F.levenshtein(F.col("s.x"), F.col("p.x"), most)).where("distance >= 0")
    return near.select(F.least("s.id", "p.id").alias("a"), F.greatest("s.id", "p.id").alias("b"), "distance").distinct()


def _blocked(left: DataFrame, right: DataFrame | None, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on every two blocks of vectors of one group; rows are (grp, id, vec, old)."""
    rows = left.withColumn("old", F.lit(False))
    if right is not None:
        rows = rows.union(right.withColumn("old", F.lit(True)))
    sizes = rows.groupBy("grp", "old").count()
    blocks = sizes.groupBy("grp").agg(*(F.coalesce(F.ceil(F.sum(F.when(F.col("old") == o, F.col("count"))) / BLOCK), F.lit(0)).cast("int").alias(f"b{int(o)}") for o in (False, True)))
    rows = rows.join(blocks, "grp")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("old"), F.col("b1")).otherwise(F.col("b0"))).cast("int")
    rows = rows.withColumn("block", mine)
    if right is None:
        others = F.transform(F.sequence(F.lit(0), F.col("b0") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    else:
        rows = rows.where("b0 > 0 AND b1 > 0")
        to = F.when(F.col("old"), F.col("b0")).otherwise(F.col("b1"))
        others = F.transform(F.sequence(F.lit(0), to - 1), lambda o: F.struct(F.when(F.col("old"), o).otherwise(F.col("block")).alias("i"), F.when(F.col("old"), F.col("block")).otherwise(o).alias("j")))
    rows = rows.withColumn("ij", F.explode(others)).select("grp", "id", "vec", "old", "block", "ij.i", "ij.j")
    return rows.groupBy("grp", "i", "j").applyInArrow(fn, schema)


def _unit(table: pa.Table) -> np.ndarray:
    m = np.array(table["vec"].to_pylist(), np.float64).reshape(table.num_rows, -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def cosine_links(df: DataFrame, group_col: str, id_col: str, vec_col: str, least: float) -> DataFrame:
    """(grp, a, b, cosine), a before b, of pairs of a group with a cosine of at least
    ``least``; zero vectors have cosine 0. Blocks are multiplied as matrices."""
    grp_type = df.schema[group_col].dataType.simpleString()
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))

    def links(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        block = t["block"].to_numpy()
        left, right = t.filter(pa.array(block == i)), t.filter(pa.array(block == j))
        sim = _unit(left) @ _unit(right).T
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        r, c = np.nonzero(sim >= least)
        keep = x[r] < y[c] if i == j else np.ones(len(r), bool)
        r, c = r[keep], c[keep]
        return pa.table({"grp": pa.array([t["grp"][0].as_py()] * len(r), t["grp"].type), "a": np.minimum(x[r], y[c]), "b": np.maximum(x[r], y[c]), "cosine": sim[r, c]})

    return _blocked(rows, None, links, f"grp {grp_type}, a long, b long, cosine double")


def nearest_old(new: DataFrame, old: DataFrame, group_col: str, id_col: str, vec_col: str) -> DataFrame:
    """(grp, id, nearest): for each new row the largest cosine to old rows of its group,
    null where the group has none."""
    grp_type = new.schema[group_col].dataType.simpleString()
    part = lambda df: df.where(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))

    def best(t: pa.Table) -> pa.Table:
        is_old = t["old"].to_numpy(zero_copy_only=False)
        mine = t.filter(pa.array(~is_old))
        sim = (_unit(mine) @ _unit(t.filter(pa.array(is_old))).T).max(1)
        return pa.table({"id": mine["id"], "nearest": sim})

    found = _blocked(part(new), part(old), best, "id long, nearest double").groupBy("id").agg(F.max("nearest").alias("nearest"))
    return new.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id")).join(found, "id", "left").select(F.col("grp").cast(grp_type).alias("grp"), "id", "nearest")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that go, of links (a, b) in the order of b."""
    gone: set[int] = set()
    for x in batches:
        now = []
        for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True):
            if a not in gone and b not in gone:
                gone.add(b)
                now.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(now, pa.int64())], names=["id"])


def greedy_removed(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id): rows that go if rows are taken in order and one goes when an earlier row
    that stays is linked to it. links: (a, b) of type long, a before b.

    Each round the rows without an open earlier neighbour stay, and what they are linked
    to goes; so a chain costs a round for every two links. Once at most ``few`` links are
    open, one task walks them in order, which gives the same rows.
    """
    live = materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "links")
    gone: list[DataFrame] = []
    while (n := live.count()) > few:
        stay = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = materialize(live.join(stay, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        rest = live.join(stay, "a", "left_anti")
        rest = rest.join(now.select(F.col("id").alias("a")), "a", "left_anti").join(now.select(F.col("id").alias("b")), "b", "left_anti")
        rest = materialize(rest.select("a", "b"), "links")
        drop(live)
        live, gone = rest, [*gone, now]
        if len(gone) == 8:  # the plan stays short however many rounds there are
            whole = materialize(functools.reduce(DataFrame.union, gone), "gone")
            drop(*gone)
            gone = [whole]
    if n or not gone:
        walked = live.repartition(1).sortWithinPartitions("b", "a").mapInArrow(_walk, "id long")
        gone.append(materialize(walked, "gone"))
    drop(live)
    return functools.reduce(DataFrame.union, gone)


def near_duplicates_removed(kept: DataFrame) -> DataFrame:
    """(id) of the near-duplicate stage: word shingles or edit distance by task."""
    links = jaccard_links(kept, "ord", "task_type", "norm").select("a", "b")
    titles = kept.where(F.col("task_type").isin([t for t, s in TASKS.items() if s.edits]))
    return greedy_removed(links.union(edit_links(titles, "ord", "norm", 2).select("a", "b")))


def stage_counts(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, stage, task_type, kept, removed): rows after each stage, by task."""
    out = None
    for i, (name, df) in enumerate(stages):
        c = df.groupBy("task_type").agg(F.count("*").alias("kept")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "task_type", "kept")
        out = c if out is None else out.union(c)
    before = out.select((F.col("step") + 1).alias("next"), F.col("task_type").alias("of"), F.col("kept").alias("before"))
    both = out.join(before, F.expr("step = next AND task_type <=> of"), "left")
    return both.select("step", "stage", "task_type", "kept", (F.coalesce("before", "kept") - F.col("kept")).alias("removed"))
