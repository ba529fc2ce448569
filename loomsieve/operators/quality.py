"""Quality metrics in long form (metric, key, value) and GO/FAIL rules over them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import text as T
from loomsieve.functions.patterns import TASKS

# Metric, operator, limit, limit in pilot mode (None: rule skipped).
RULES: list[tuple[str, str, float, float | None]] = [
    ("starting_phrase_top1", "<=", 0.20, 0.35),
    ("first_3words_unique", ">=", 0.50, 0.30),
    ("leakage", "<=", 0.0, None),
    ("task_ratio_edge", "<=", 0.02, 0.02),
    ("intra_group_cosine", "<=", 0.85, 0.85),
    ("variation_combos", ">=", 30.0, 10.0),
    ("persona_occasion_combos", ">=", 35.0, 20.0),
    ("persona_occasion_std_ratio", "<=", 0.30, 0.30),
    ("xsim_avg", "<=", 0.80, 0.80),
    ("xsim_max", "<=", 0.95, 0.95),
    ("human_good", ">=", 0.80, 0.80),
    ("human_bad", "<=", 0.05, 0.05),
    ("auto_eval_rate", ">=", 80.0, 80.0),
    ("latency_p95", "<", 3.0, 3.0),
]


def starting_phrases(df: DataFrame, text: Column) -> DataFrame:
    """(task_type, rows, top1, unique3): share of the commonest first word, and of
    different first three words, over rows with a text. Two levels of aggregation, so a
    common word is combined before the shuffle."""
    rows = df.select("task_type", T.first_words(text, 1).alias("w1"), T.first_words(text, 3).alias("w3")).where("w1 <> ''")
    first = rows.groupBy("task_type", "w1").agg(F.count("*").alias("n")).groupBy("task_type").agg(F.max("n").alias("most"), F.sum("n").alias("rows"))
    three = rows.groupBy("task_type", "w3").agg(F.count("*").alias("n")).groupBy("task_type").agg(F.count("*").alias("different"))
    out = first.alias("w").join(three.alias("t"), F.expr("w.task_type <=> t.task_type"))
    return out.select("w.task_type", "rows", (F.col("most") / F.col("rows")).alias("top1"), (F.col("different") / F.col("rows")).alias("unique3"))


def combo_balance(df: DataFrame, a: str, b: str) -> DataFrame:
    """(combos, rows, std_ratio): different pairs and population deviation over mean of
    their counts; rows without a or with a blank a don't count."""
    counts = df.where(F.coalesce(F.col(a), F.lit("")) != "").groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("combos"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.stddev_pop("n") / F.avg("n"), F.lit(0.0)).alias("std_ratio"))


def task_ratios(df: DataFrame) -> DataFrame:
    """(split, task_type, ratio) of the known tasks, 0 where a split has none."""
    counts = df.where(F.col("split").isNotNull()).groupBy("split").agg(F.count("*").alias("all"), *(F.sum((F.col("task_type") == t).cast("long")).alias(t) for t in TASKS))
    pairs = ", ".join(f"'{t}', `{t}`" for t in TASKS)
    return counts.selectExpr("split", f"stack({len(TASKS)}, {pairs}) AS (task_type, n)", "`all`").select("split", "task_type", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("ratio"))


def ratio_edges(ratios: DataFrame) -> DataFrame:
    """(task_type, edge): largest difference between splits."""
    return ratios.groupBy("task_type").agg((F.max("ratio") - F.min("ratio")).alias("edge"))


def leakage(df: DataFrame, group_col: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(split_a, split_b, shared): groups that stand in both splits."""
    has = [F.max((F.col("split") == s).cast("int")).alias(f"in_{i}") for i, s in enumerate(splits)]
    groups = df.where(F.col("split").isin(*splits) & F.col(group_col).isNotNull()).groupBy(group_col).agg(*has)
    pairs = list(itertools.combinations(range(len(splits)), 2))
    counts = groups.agg(*(F.coalesce(F.sum(F.col(f"in_{i}") * F.col(f"in_{j}")), F.lit(0)).alias(f"n_{i}_{j}") for i, j in pairs))
    args = ", ".join(f"'{splits[i]}', '{splits[j]}', n_{i}_{j}" for i, j in pairs)
    return counts.selectExpr(f"stack({len(pairs)}, {args}) AS (split_a, split_b, shared)")


def intra_group_cosine(df: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """(grp, n, cosine): mean cosine of all pairs of each group of two or more rows, in
    closed form: (|sum v|^2 - sum |v|^2) / (n (n - 1)). Linear, and combined before the
    shuffle; no pairs are made."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = df.where(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("grp"), F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)).alias("u"))
    sizes = unit.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("own"))
    sums = unit.select("grp", F.posexplode("u").alias("i", "x")).groupBy("grp", "i").agg(F.sum("x").alias("x")).groupBy("grp").agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    out = sizes.alias("s").join(sums.alias("t"), F.expr("s.grp <=> t.grp")).where("n >= 2")
    return out.select("s.grp", "n", ((F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("cosine"))


def evaluated(metrics: DataFrame, pilot: bool = False, rules: list[tuple[str, str, float, float | None]] = RULES) -> DataFrame:
    """(metric, key, value, op, limit, status) of every rule for each key of its metric
    (metric, key, value): kept, broken, or not evaluated where there is no value."""
    given = [(m, op, float(p if pilot else x)) for m, op, x, p in rules if not (pilot and p is None)]
    table = metrics.sparkSession.createDataFrame(given, "metric string, op string, `limit` double")
    v, lim, op = F.col("value"), F.col("limit"), F.col("op")
    ok = F.when(op == "<=", v <= lim).when(op == ">=", v >= lim).otherwise(v < lim)
    status = F.when(v.isNull(), "not evaluated").when(ok, "kept").otherwise("broken")
    return metrics.join(F.broadcast(table), "metric", "right").select("metric", "key", "value", "op", "limit", status.alias("status"))


def violations(metrics: DataFrame, pilot: bool = False, rules: list[tuple[str, str, float, float | None]] = RULES) -> DataFrame:
    """(metric, key, value, op, limit) of the metrics (metric, key, value) that break a
    rule. A rule without a metric gives no row here, but one of ``evaluated``."""
    return evaluated(metrics, pilot, rules).where("status = 'broken'").drop("status")


def verdict(metrics: DataFrame, pilot: bool = False) -> DataFrame:
    """(status, reasons, not_evaluated): PASS or FAIL with the messages of the broken
    rules, and the rules that nothing is known of; PASS is of the others alone."""
    said = F.format_string("%s[%s] not %s %s", F.col("metric"), F.coalesce("key", F.lit("")), F.col("op"), F.col("limit").cast("string"))
    of = lambda status, x: F.sort_array(F.collect_list(F.when(F.col("status") == status, x)))
    lists = evaluated(metrics, pilot).agg(of("broken", said).alias("reasons"), F.array_distinct(of("not evaluated", F.col("metric"))).alias("not_evaluated"))
    return lists.select(F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL").alias("status"), "reasons", "not_evaluated")
