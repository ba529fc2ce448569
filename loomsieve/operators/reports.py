"""Figures of runs and reports: scenario passes, counters, thresholds, stage lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rates of the response task and what they must reach, in per cent.
THRESHOLDS = [("json_parse_rate", 95.0), ("keys_present_rate", 95.0), ("comment_length_ok", 95.0), ("honorific_rate", 95.0), ("no_emoji_rate", 95.0), ("no_survey_word_rate", 100.0)]


def scenario_counts(results: DataFrame, category_col: str, passed_col: str) -> DataFrame:
    """(category, passed, total, all_passed); a result without a verdict didn't pass."""
    ok = F.coalesce(F.col(passed_col), F.lit(False))
    return results.groupBy(F.col(category_col).alias("category")).agg(F.sum(ok.cast("long")).alias("passed"), F.count("*").alias("total"), F.bool_and(ok).alias("all_passed"))


def run_counters(calls: DataFrame, task_col: str, ok_col: str) -> DataFrame:
    """(task, calls, success, failures) of a log of calls, and a row for all (task null
    and overall true). One pass: a rollup, not counters that tasks share."""
    ok = F.coalesce(F.col(ok_col), F.lit(False)).cast("long")
    out = calls.select(F.col(task_col).alias("task"), F.col(ok_col)).rollup("task").agg(F.grouping("task").cast("boolean").alias("overall"), F.count("*").alias("calls"), F.sum(ok).alias("success"))
    return out.select("task", "overall", "calls", "success", (F.col("calls") - F.col("success")).alias("failures"))


def mixed_total(parts: DataFrame, keys: tuple[str, ...] = ("total", "total_evaluated")) -> DataFrame:
    """(total): sum over rows of the first of ``keys`` that a row has, 0 if none."""
    return parts.agg(F.coalesce(F.sum(F.coalesce(*map(F.col, keys))), F.lit(0)).cast("long").alias("total"))


def threshold_report(rates: DataFrame, thresholds: list[tuple[str, float]] = THRESHOLDS) -> DataFrame:
    """(metric, value, needed, passed) for each threshold, from a row of rates."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(x).alias("needed")) for m, x in thresholds))
    return rates.select(F.inline(rows)).withColumn("passed", F.col("value") >= F.col("needed"))


def stage_lookup(stages: DataFrame, name: str) -> DataFrame:
    """(overall_avg, overall_max) of the first stage (step, name, avg_by_task,
    max_by_task) of that name; no row if there is none, nulls if it has no tasks."""
    first = stages.where(F.col("name") == name).agg(F.min_by(F.struct("avg_by_task", "max_by_task"), "step").alias("s")).where("s IS NOT NULL").select("s.*")
    avg = F.map_values("avg_by_task")
    mean = F.when(F.size(avg) > 0, F.aggregate(avg, F.lit(0.0), lambda s, x: s + x) / F.size(avg))
    return first.select(mean.alias("overall_avg"), F.array_max(F.map_values("max_by_task")).alias("overall_max"))
