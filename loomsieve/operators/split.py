"""Group folds: groups stay whole, strata as even as they can be."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.operators.quality import leakage
from loomsieve.storage import materialize

#: A group with more than 1/HEAVY of the rows is placed by itself (at most HEAVY groups).
HEAVY = 200
#: Most strata that are kept apart.
STRATA = 64


def group_folds(df: DataFrame, group_col: str, stratum_col: str, folds: int = 10, seed: int = 42) -> DataFrame:
    """(grp, fold) for every group; null groups count as one.

    Heavy groups are placed greedily where they keep strata most even; the others lie in
    hash order along their main stratum, which is cut where the room that each fold has
    left in it ends. Only the heavy groups' counts and the sizes of the strata reach the
    driver; strata beyond STRATA share hash groups.
    """
    if df.select(stratum_col).distinct().limit(STRATA + 1).count() > STRATA:
        df = df.withColumn(stratum_col, F.pmod(F.xxhash64(stratum_col), F.lit(STRATA)).cast("string"))
    counts = materialize(df.groupBy(F.col(group_col).alias("grp"), F.col(stratum_col).alias("stratum")).agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("grp").agg(F.sum("n").alias("size"), F.max_by("stratum", F.struct("n", "stratum")).alias("main"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    heavy = sizes.where(F.col("size") * HEAVY > total).select("grp")
    need: dict = {}
    for r in counts.alias("c").join(heavy.alias("h"), F.expr("c.grp <=> h.grp"), "left_semi").collect():
        need.setdefault(r.grp, {})[r.stratum] = r.n
    load: list[dict] = [{} for _ in range(folds)]
    placed = []
    for g, own in sorted(need.items(), key=lambda x: (-sum(x[1].values()), str(x[0]))):
        best = min(range(folds), key=lambda f: (sum((load[f].get(t, 0) + n) ** 2 - load[f].get(t, 0) ** 2 for t, n in own.items()), sum(load[f].values()), f))
        for t, n in own.items():
            load[best][t] = load[best].get(t, 0) + n
        placed.append((g, best))
    kind = df.schema[group_col].dataType.simpleString()
    done = df.sparkSession.createDataFrame(placed, f"grp {kind}, fold int")
    light = sizes.alias("s").join(heavy.alias("h"), F.expr("s.grp <=> h.grp"), "left_anti").withColumn("h", F.xxhash64("grp", F.lit(seed)))
    cuts = []
    for r in counts.groupBy("stratum").agg(F.sum("n").alias("n")).collect():
        room = [max(0.0, r.n / folds - x.get(r.stratum, 0)) for x in load]
        ends = list(itertools.accumulate(x / (sum(room) or 1) for x in room))
        cuts.append((r.stratum, [*ends[:-1], 2.0]))
    stratum = counts.schema["stratum"].dataType.simpleString()
    ends = df.sparkSession.createDataFrame(cuts, f"main {stratum}, ends array<double>")
    # prefix sums over hash buckets, so no window holds all groups
    light = light.withColumn("bucket", F.pmod("h", F.lit(128)))
    over = Window.partitionBy("main")
    sums = light.groupBy("main", "bucket").agg(F.sum("size").alias("b"))
    sums = sums.select(F.col("main").alias("m"), F.col("bucket").alias("k"), (F.sum("b").over(over.orderBy("bucket")) - F.col("b")).alias("before"), F.sum("b").over(over).alias("all"))
    upto = F.sum("size").over(Window.partitionBy("main", "bucket").orderBy("h", "grp").rowsBetween(Window.unboundedPreceding, 0))
    at = light.withColumn("upto", upto).join(F.broadcast(sums), F.expr("main <=> m AND bucket = k")).drop("m").join(F.broadcast(ends.withColumnRenamed("main", "m")), F.expr("main <=> m"))
    where = (F.col("before") + F.col("upto") - F.col("size") / 2) / F.col("all")
    return done.union(at.select("grp", F.size(F.filter("ends", lambda e: e < where)).alias("fold")))


def train_val_test(df: DataFrame, group_col: str, stratum_col: str, seed: int = 42) -> DataFrame:
    """Adds split: fold 0 is test, fold 1 val, the other eight train."""
    folds = group_folds(df, group_col, stratum_col, 10, seed).withColumnRenamed("grp", "_grp")
    out = df.join(folds, F.col(group_col).eqNullSafe(F.col("_grp")))
    return out.withColumn("split", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")).drop("_grp", "fold")


def assert_no_leakage(df: DataFrame, group_col: str) -> DataFrame:
    """df, or ValueError if a group stands in more than one split."""
    shared = {(r.split_a, r.split_b): r.shared for r in leakage(df, group_col).collect()}
    if any(shared.values()):
        raise ValueError(f"groups in more than one split: {shared}")
    return df
