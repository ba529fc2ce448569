"""Mixing sources to target shares of tokens (problem 9): entropy balancing.

Among all document rates w that give each source its tokens, the ones nearest to use
every document once (in relative entropy) are exponentially tilted,
w = min(cap, exp(lambda_source * tokens / mean)). Newton iterations, kept within a
bracket, solve the dual for all sources at once; each is one distributed aggregation
over the counts of documents by source and size. The rates are rounded into copies by
a systematic pass along documents of like size; what rare long documents then leave
over or short is made up by single copies of others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.storage import materialize

ITERATIONS, CLOSE = 40, 1e-6
#: Hash buckets within a size class, over which the rounding runs.
SALTS = 64


def _solve(hist: DataFrame, wanted: dict[str, float], caps: dict[str, int], mean: dict[str, float]) -> dict[str, float]:
    """lambda of each source in ``wanted``; all targets lie below the cap."""
    lam = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    open_ = set(wanted)
    spark = hist.sparkSession
    for _ in range(ITERATIONS):
        if not open_:
            break
        at = spark.createDataFrame([(s, lam[s], float(caps[s]), mean[s]) for s in open_], "source string, lam double, cap double, mean double")
        x = F.col("tokens") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        now = hist.join(F.broadcast(at), "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * F.least("cap", tilt)).alias("f"),
            F.sum(F.when(tilt < F.col("cap"), F.col("n") * F.col("tokens") * x * tilt).otherwise(0.0)).alias("d"),
        )
        for r in now.collect():
            s, miss = r.source, r.f - wanted[r.source]
            if abs(miss) <= CLOSE * wanted[s]:
                open_.discard(s)
                continue
            if miss > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - miss / r.d if r.d else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else lam[s] + (-1 if miss > 0 else 1) * (1 + abs(lam[s]))
            lam[s] = step
    return lam


def _made_up(copies: DataFrame, wanted: dict[str, float], caps: dict[str, int]) -> DataFrame:
    """Give or take one copy of documents, in hash order, up to what a source misses."""
    got = {r.source: r.t for r in copies.where("copies > 0").groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect()}
    misses = copies.sparkSession.createDataFrame([(s, float(w - got.get(s, 0)), caps[s]) for s, w in wanted.items()], "source string, miss double, cap int")
    at = copies.join(F.broadcast(misses), "source", "left").withColumn("h", F.xxhash64("id", F.lit(90)))
    may = F.coalesce((F.col("tokens") > 0) & (F.col("tokens") <= F.abs("miss")) & F.when(F.col("miss") > 0, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0), F.lit(False))
    at = at.withColumn("give", F.when(may, F.col("tokens")).otherwise(0)).withColumn("bucket", F.shiftright("h", 54))
    steps = at.groupBy("source", "bucket").agg(F.sum("give").alias("g"))
    before = steps.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.sum("g").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    run = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("upto", F.sum("give").over(run)).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    change = F.when((F.col("give") > 0) & (F.coalesce("before", F.lit(0)) + F.col("upto") <= F.abs("miss")), F.signum("miss").cast("long")).otherwise(F.lit(0))
    return materialize(at.select("id", "source", "tokens", (F.col("copies") + change).alias("copies")), "copies")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Operator: (copies, report).

    sizes: (id, source, tokens), a row for each document; targets: (source,
    target_share, max_repeats), a short table. copies: (id, source, tokens, copies) for
    every document, 0 for sources that aren't listed or null. report: a row for each
    listed source with target and actual share, documents, documents used, copies and
    tokens. total_tokens: size of the mix; by default the largest at which every source
    that has tokens reaches its share within its cap. A source that can't reach its
    share is used up to its cap, and the report says so; the shares of listed sources
    without tokens go to the others in proportion. Documents without tokens get 0.
    """
    spark = sizes.sparkSession
    sizes = materialize(sizes.select("id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "sizes")
    goals = {r.source: (r.target_share, r.max_repeats) for r in targets.collect() if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    listed = spark.createDataFrame([(s,) for s in goals], "source string")
    hist = materialize(sizes.where("tokens > 0").join(F.broadcast(listed), "source", "left_semi").groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    have = {r.source: (float(r.t), float(r.n)) for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    whole = sum(goals[s][0] for s in have) or 1.0
    share = {s: goals[s][0] / whole for s in have}
    caps = {s: goals[s][1] for s in have}
    total = total_tokens if total_tokens is not None else min((caps[s] * have[s][0] / share[s] for s in have), default=0.0)
    wanted = {s: share[s] * total for s in have}
    at_cap = {s for s in have if wanted[s] >= caps[s] * have[s][0] * (1 - 1e-9)}
    mean = {s: have[s][0] / have[s][1] for s in have}
    lam = _solve(hist, {s: w for s, w in wanted.items() if s not in at_cap and w > 0}, caps, mean)
    rates = spark.createDataFrame([(s, lam.get(s), float(caps[s]), mean[s]) for s in have], "source string, lam double, cap double, mean double")

    # whole copies are certain; the rest is taken along documents of like size
    tilted = sizes.join(F.broadcast(rates), "source", "left")
    rate = F.when(F.col("cap").isNull() | (F.col("tokens") <= 0), 0.0).when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least("cap", F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(50.0)))))
    tilted = tilted.select("id", "source", "tokens", rate.alias("rate"), F.xxhash64("id", F.lit(9)).alias("h"))
    tilted = tilted.withColumn("size_class", F.when(F.col("rate") > 0, F.floor(F.log2("tokens") * 8).cast("int"))).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).withColumn("part", F.col("rate") - F.floor("rate"))
    steps = tilted.where("part > 0").groupBy("source", "size_class", "salt").agg(F.sum("part").alias("p"))
    before = steps.select("source", "size_class", "salt", (F.sum("p").over(Window.partitionBy("source").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    run = Window.partitionBy("source", "size_class", "salt").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    summed = tilted.where("part > 0").withColumn("upto", F.sum("part").over(run)).join(before, ["source", "size_class", "salt"])
    upto = F.coalesce("before", F.lit(0.0)) + F.col("upto") + F.lit(0.5)
    partly = summed.select("id", "source", "tokens", (F.floor("rate") + F.floor(upto) - F.floor(upto - F.col("part"))).cast("long").alias("copies"))
    copies = materialize(tilted.where("part = 0").select("id", "source", "tokens", F.col("rate").cast("long").alias("copies")).union(partly), "copies")
    copies = _made_up(copies, {s: min(wanted[s], caps[s] * have[s][0]) for s in have}, caps)

    used = copies.groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(F.col("copies") > 0, 1)).alias("used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_repeats"))
    report = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["documents", "used", "copies", "mixed_tokens", "most_repeats"])
    report = report.withColumn("actual_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), F.lit(1)))
    return copies, report
