"""Filling containers of fixed capacity (problem 8): best-two-fit.

A text larger than the capacity is cut into pieces of the capacity and a rest; others
are never split. Items are spread over hash shards that one task packs each. Bins that
stay underfilled are opened again and their items packed anew, in as many shards as they
fill: the few last bins of each shard so meet those of the others, round after round,
until one shard is left or opening helps no more. No task ever packs more than about
``SHARD`` items.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.storage import materialize

#: Items that one task packs, the fill below which a bin is opened again, and the share
#: of the items that may be left open for another round to be worth it.
SHARD, FULL, WORTH = 6_000, 0.985, 0.8


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are from 1 to capacity.

    A bin starts with the largest item left and takes the largest that fits until none
    does. Then its smallest item is taken out if two unpacked ones fill the gap more
    tightly than it did, the tightest two of all. Items of a size are interchangeable,
    so the pool is a count for each size.
    """
    order = np.argsort(sizes, kind="stable")
    first = np.searchsorted(sizes[order], np.arange(capacity + 2))
    left = np.bincount(sizes, minlength=capacity + 1)
    given = left.copy()
    have = left > 0
    out, number = np.empty(len(sizes), np.int64), 0
    top = capacity
    # below[s]: a size that is at least the largest one left that is at most s
    below = np.arange(capacity + 1)

    def fit(gap: int) -> int:
        s = gap
        while s > 0 and not left[s]:
            s = below[s] - 1 if below[s] < s else s - 1
        if gap > s:
            below[gap] = min(below[gap], s + 1) if not left[gap] else gap
        return max(s, 0)

    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top == 0:
            return out
        took, gap = [], capacity
        while gap > 0 and (s := fit(gap)):
            left[s] -= 1
            have[s] = left[s] > 0
            took.append(s)
            gap -= s
        if gap > 0 and len(took) > 1:
            s, room = took[-1], gap + took[-1]  # the largest comes first, the smallest last
            pool = np.flatnonzero(have[:room])
            if len(pool):
                partner = np.searchsorted(pool, room - pool, side="right") - 1
                ok = partner >= 0
                both = np.where(ok, pool + pool[partner], 0)
                both[(partner == np.arange(len(pool))) & (left[pool] < 2)] = 0
                k = int(both.argmax())
                if both[k] > s:
                    a, b = int(pool[k]), int(pool[partner[k]])
                    left[a] -= 1
                    left[b] -= 1
                    have[a], have[b] = left[a] > 0, left[b] > 0
                    took[-1:] = [a, b]
                    left[s] += 1
                    have[s] = True
                    below[s] = s
                    below[s:] = np.arange(s, capacity + 1)  # what was known above s no longer holds
        for s in took:
            given[s] -= 1
            out[order[first[s] + given[s]]] = number
        number += 1


def _packer(step: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _packed(table, step)


def _packed(table: pa.Table, step: int) -> pa.Table:
    sizes, capacity = table["size"].to_numpy(), table["capacity"][0].as_py()
    bins = best_two_fit(sizes, capacity)
    fill = np.bincount(bins, weights=sizes)[bins] / capacity
    name = f"{step}-{table['shard'][0].as_py()}-"
    labels = pa.array([name + str(b) for b in bins.tolist()])
    return table.select(["container", "capacity", "id", "piece", "size"]).append_column("bin", labels).append_column("fill", pa.array(fill))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Operator: (container, capacity, id, piece, size, bin, fill), for every container
    on its own the bin of each item.

    sizes: (id, tokens), a row for each text; containers: (container, capacity), a short
    table. piece counts from 0. Texts without tokens need no space: bin null. Pieces of
    the capacity are a bin by themselves. Repeated ids stay apart as rows; null or
    non-positive capacities pack nothing.
    """
    wanted = [r for r in containers.select("container", F.col("capacity").cast("int").alias("capacity")).distinct().collect() if r.capacity and r.capacity > 0]
    each = F.array(*(F.struct(F.lit(r.container).alias("container"), F.lit(r.capacity).alias("capacity")) for r in wanted)) if wanted else F.from_json(F.lit("[]"), "array<struct<container: string, capacity: int>>")
    sizes = materialize(sizes.select("id", "tokens"), "sizes")  # tokens are counted once
    all_ = sizes.select("id", "tokens", F.explode(each).alias("c")).select("id", "tokens", "c.container", "c.capacity")
    none = all_.where("tokens <= 0 OR tokens IS NULL").select("container", "capacity", "id", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("double").alias("fill"))
    pieces = all_.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)))
    pieces = pieces.select("container", "capacity", "id", "piece", F.least("capacity", F.col("tokens") - F.col("piece").cast("long") * F.col("capacity")).cast("int").alias("size"))
    whole = pieces.where("size = capacity").select("*", F.concat_ws("-", F.lit("whole"), "id", "piece", F.monotonically_increasing_id()).alias("bin"), F.lit(1.0).alias("fill"))
    open_ = pieces.where("size < capacity")
    schema = "container string, capacity int, id long, piece int, size int, bin string, fill double"
    items, done, step = materialize(open_, "items"), none.union(whole), 0
    many = lambda df: df.groupBy("container").count().agg(F.max("count")).first()[0] or 0
    count, names = many(items), sorted({r.container for r in wanted}, key=str)
    place = F.coalesce(*(F.when(F.col("container").eqNullSafe(c), i) for i, c in enumerate(names)), F.lit(0))
    while True:
        shards = max(1, -(-count // SHARD))
        spread = items.withColumn("shard", (place * shards + F.pmod(F.xxhash64("id", "piece", F.lit(step)), F.lit(shards))).cast("int"))
        spread = spread.repartitionById(max(1, len(names)) * shards, "shard")  # a task for each shard
        packed = materialize(spread.groupBy("shard").applyInArrow(_packer(step), schema), "packed")
        left = many(packed.where(F.col("fill") < FULL)) if shards > 1 else 0
        if shards == 1 or left > WORTH * count:
            return done.union(packed)
        done = done.union(packed.where(F.col("fill") >= FULL))
        items, count, step = packed.where(F.col("fill") < FULL).select("container", "capacity", "id", "piece", "size"), left, step + 1


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, items, tokens, bins, least_bins, fill) of a packing."""
    of = packed.where("bin IS NOT NULL").groupBy("container", "capacity", "bin").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"))
    out = of.groupBy("container", "capacity").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count("*").alias("bins"))
    return out.select("*", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))
