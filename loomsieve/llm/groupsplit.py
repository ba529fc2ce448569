"""Splits that keep related records together (problem 6).

Records that share an entity key form a component. Components live in a persisted table
(``Components``); a new batch is merged into it by hooking to the least neighbour and
pointer jumping. An existing component keeps its split; new ones fill the deficits, of
the batches before and this one; where components of different splits are merged, the
result is quarantined: flagged, and put whole into one split by the same rule as new
ones, so nothing leaks.

The driver sees the deficits (splits x strata) and at most ``HEAVY`` components; the
rest is placed by prefix sums over hash buckets.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.llm._pairs import hot_values, spread_join
from loomsieve.llm.versions import Versions
from loomsieve.storage import drop, materialize

#: A free component with more than 1/HEAVY of the free records is placed by itself; so
#: there are fewer than HEAVY of them whatever the input.
HEAVY = 256
#: Hash buckets over which the prefix sums of a stratum run.
BUCKETS = 256
#: Strata beyond this number share hash groups.
STRATA = 64


def clean_key(c: Column) -> Column:
    """An id without surrounding blanks, in lower case, without version endings."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(_v\d+)+$", "")


def connected(edges: DataFrame) -> DataFrame:
    """(key, component) for every key of ``edges`` (u, v); component is the least key.

    Each round every vertex hooks to its least neighbour, the trees are flattened by
    pointer jumping, and the edges are contracted; so rounds grow as the logarithm of
    the largest component. Hot vertices cost one aggregated row for each task.
    """
    edges = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct(), "edges")
    total = materialize(edges.select(F.col("u").alias("key")).union(edges.select("v")).distinct().select("key", F.col("key").alias("component")), "components")
    now = materialize(edges.where("u <> v"), "edges")
    drop(edges)
    while not now.isEmpty():
        both = now.union(now.select("v", "u"))
        hook = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "hook")
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp")).hint("merge")
            jumped = materialize(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "jump")
            drop(hook)
            hook = jumped
            if jumped.where("moved").isEmpty():
                break
        at = hook.select(F.col("u").alias("component"), "p").hint("merge")
        before, total = total, materialize(total.join(at, "component", "left").select("key", F.coalesce("p", "component").alias("component")), "components")
        a, b = hook.select("u", F.col("p").alias("pu")).hint("merge"), hook.select(F.col("u").alias("v"), F.col("p").alias("pv")).hint("merge")
        old, now = now, materialize(now.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct(), "edges")
        drop(before, old, hook)
    drop(now)
    return total


def build_components(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(key, component, splits, given) from records (id, keys, stratum, split) and an
    existing table (key, component, split, splits). splits are the different splits that
    records of the component stand in, given those its existing components were put
    into; at most as many as there are splits. Keys only of ``existing`` stay."""
    first = F.element_at("keys", 1)
    edges = records.select(first.alias("u"), F.explode("keys").alias("v"))
    said = records.where("split IS NOT NULL").select(first.alias("key"), "split", F.lit(None).cast("string").alias("given"))
    if existing is not None:
        edges = edges.union(existing.select(F.col("component").alias("u"), F.col("key").alias("v")))
        said = said.union(existing.select("key", F.explode_outer("splits").alias("split"), F.col("split").alias("given")))
    components = connected(edges)
    said = said.distinct().join(components.hint("merge"), "key").groupBy("component")
    splits = said.agg(F.sort_array(F.collect_set("split")).alias("splits"), F.sort_array(F.collect_set("given")).alias("given"))
    none = F.array().cast("array<string>")
    return components.join(splits.hint("merge"), "component", "left").select("key", "component", F.coalesce("splits", none).alias("splits"), F.coalesce("given", none).alias("given"))


def assign_splits(
    records: DataFrame, targets: dict[str, float], existing: DataFrame | None = None, before: dict[str, dict[str, int]] | None = None, keep_present: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Operator: (components, assignments).

    records: (id, keys array of non-null strings with at least one, stratum, split);
    targets: share of each split. components: (key, component, split, splits, status),
    to be given as ``existing`` next time; assignments: (id, component, stratum, split,
    status), a row for each record. status is kept, new or quarantined. Splits of
    records that aren't in ``targets`` count as none. Equal ids stay separate rows.
    before: rows of earlier batches by split and stratum, for the deficits.
    keep_present: a component that isn't in ``existing`` and whose records all stand in
    one split keeps that, and one whose records stand in several is quarantined; else
    both are new, and the records' splits are only noted in ``splits``.
    """
    names, whole = list(targets), sum(targets.values()) or 1.0
    known = records.select("id", "keys", F.coalesce("stratum", F.lit("")).alias("stratum"), F.when(F.col("split").isin(names), F.col("split")).alias("split"))
    known = materialize(known, "records")
    if known.select("stratum").distinct().limit(STRATA + 1).count() > STRATA:
        known = known.withColumn("stratum", F.pmod(F.xxhash64("stratum"), F.lit(STRATA)).cast("string"))
    known_hot = hot_values(known.select(F.element_at("keys", 1).alias("key")), "key")
    built = build_components(known, existing)
    held = F.when(F.size("given") > 0, F.col("given")).otherwise(F.col("splits") if keep_present else F.array().cast("array<string>"))
    components = materialize(built.select("key", "component", held.alias("splits"), F.col("splits").alias("stood")), "components")
    of_first = components.select(F.col("key").alias("first_key"), "component", "splits").hint("merge")
    counts = known.groupBy(F.element_at("keys", 1).alias("first_key"), "stratum").agg(F.count("id").alias("n")).join(of_first, "first_key")
    counts = materialize(counts.groupBy("component", "stratum", "splits").agg(F.sum("n").alias("n")), "counts")

    wanted: dict[tuple[str, str], float] = {}
    for r in counts.groupBy("stratum").agg(F.sum("n").alias("n"), *(F.sum(F.when((F.size("splits") == 1) & (F.get("splits", F.lit(0)) == s), F.col("n")).otherwise(0)).alias(f"_{i}") for i, s in enumerate(names))).collect():
        for i, s in enumerate(names):
            wanted[s, r.stratum] = targets[s] / whole * r.n - r[f"_{i}"]
    for t in {t for of in (before or {}).values() for t in of}:
        rows = sum(of.get(t, 0) for of in before.values())
        for s in names:
            wanted[s, t] = wanted.get((s, t), 0.0) + targets[s] / whole * rows - before.get(s, {}).get(t, 0)

    free = counts.where("size(splits) <> 1")
    sizes = materialize(free.groupBy("component").agg(F.sum("n").alias("size"), F.max_by("stratum", F.struct("n", "stratum")).alias("main")), "free")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    heavy_ids = sizes.where(F.col("size") * HEAVY > total).select("component", "size")
    heavy: dict[str, dict[str, int]] = {}
    for r in free.join(heavy_ids, "component").select("component", "stratum", "n").collect():
        heavy.setdefault(r.component, {})[r.stratum] = r.n
    placed = []
    for c, need in sorted(heavy.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        over = {s: sum(v for (t, _), v in wanted.items() if t == s) for s in names}
        size = sum(need.values())
        # the least sum of squared deficits afterwards, overall and within strata
        best = min(names, key=lambda s: (size * (size - 2 * over[s]) + sum(n * (n - 2 * wanted[s, t]) for t, n in need.items()), s))
        for t, n in need.items():
            wanted[best, t] -= n
        placed.append((c, best))
    spark = records.sparkSession
    done = spark.createDataFrame(placed, "component string, put string")

    # light ones: along a stratum in random order, cut where the deficits end
    strata = sorted({t for _, t in wanted})
    cuts = []
    for t in strata:
        open_ = [max(0.0, wanted[s, t]) for s in names]
        shares = [x / (sum(open_) or 1) for x in open_] if sum(open_) else [targets[s] / whole for s in names]
        ends = list(itertools.accumulate(shares))
        cuts.append((t, [*ends[:-1], 2.0]))
    ends = spark.createDataFrame(cuts, "main string, ends array<double>")
    light = sizes.join(done.select("component"), "component", "left_anti").withColumn("h", F.xxhash64("component", F.lit(6))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    buckets = light.groupBy("main", "bucket").agg(F.sum("size").alias("b"))
    over = Window.partitionBy("main")
    buckets = buckets.select("main", "bucket", (F.sum("b").over(over.orderBy("bucket")) - F.col("b")).alias("before"), F.sum("b").over(over).alias("all"))
    inside = Window.partitionBy("main", "bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    at = light.withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(buckets), ["main", "bucket"]).join(F.broadcast(ends), "main")
    where = (F.col("before") + F.col("upto") - F.col("size") / 2) / F.greatest("all", F.lit(1))
    light = at.select("component", F.element_at(F.array(*map(F.lit, names)), F.size(F.filter("ends", lambda e: e < where)) + 1).alias("put"))

    splits = components.join(done.union(light).hint("merge"), "component", "left")
    n = F.size("splits")
    table = splits.select("key", "component", F.when(n == 1, F.get("splits", F.lit(0))).otherwise(F.col("put")).alias("split"), F.col("stood").alias("splits"), F.when(n == 1, "kept").when(n == 0, "new").otherwise("quarantined").alias("status"))
    table = materialize(table, "components")
    rows = spread_join(known.select("id", "stratum", F.element_at("keys", 1).alias("key")), table.drop("splits"), ["key"], known_hot)
    return table, rows.select("id", "component", "stratum", "split", "status")


class Components:
    """The component table in a named folder, which is made or opened: (key, component,
    split, splits, status), with the rows of each split and stratum so far in the
    manifest. Rows of a component that is moved by a quarantine stay counted where they
    were first put."""

    columns = "key string, component string, split string, splits array<string>, status string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Versions(spark, folder)

    def rows(self) -> DataFrame:
        if not self.store.state:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(self.store.at(self.store.state["table"]))

    def add(self, records: DataFrame, targets: dict[str, float], keep_present: bool = True) -> DataFrame:
        """Merge a batch of records into the table; the batch's assignments."""
        state = self.store.state
        before = state["rows"] if state else {}
        table, assigned = assign_splits(records, targets, self.rows() if state else None, before, keep_present)
        assigned = materialize(assigned, "assigned")
        counts = {s: dict(of) for s, of in before.items()}
        for r in assigned.where("id IS NOT NULL").groupBy("split", "stratum").agg(F.count("*").alias("n")).collect():
            of = counts.setdefault(r.split, {})
            of[r.stratum] = of.get(r.stratum, 0) + r.n
        folder = self.store.new_folder("components")
        table.write.option("compression", "zstd").parquet(self.store.at(folder))
        self.store.commit({"table": folder, "rows": counts}, {folder})
        drop(table)
        return assigned

    def assigned(self, records: DataFrame) -> DataFrame:
        """(id, component, stratum, split, status) of records of any batch so far, by the
        table as it now is."""
        rows = records.select("id", F.coalesce("stratum", F.lit("")).alias("stratum"), F.element_at("keys", 1).alias("key"))
        return spread_join(rows, self.rows().drop("splits"), ["key"], hot_values(rows.select("key"), "key")).select("id", "component", "stratum", "split", "status")
