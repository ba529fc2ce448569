"""Writing JSON Lines, reports, review sheets and seed documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.sources.readers import exists


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of JSON Lines. An input is never overwritten in place: give a new path."""
    df.write.mode("append" if append else "overwrite").json(path)


def by_split(df: DataFrame, folder: str) -> None:
    """Parquet by split and task, for reads that prune."""
    df.write.mode("overwrite").partitionBy("split", "task_type").parquet(folder)


def replace_with_backup(df: DataFrame, path: str) -> None:
    """Write beside, move the old folder to <path>_raw unless there is one, move in."""
    spark = df.sparkSession
    jsonl(df, f"{path}_new")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if exists(spark, path):
        if exists(spark, f"{path}_raw"):
            fs.delete(fs_path(path), True)
        else:
            fs.rename(fs_path(path), fs_path(f"{path}_raw"))
    fs.rename(fs_path(f"{path}_new"), fs_path(path))


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs_path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def report(metrics: DataFrame, path: str) -> dict:
    """Metrics (metric, key, value), a few rows, as one nested, indented JSON document."""
    out: dict = {}
    for r in metrics.collect():
        if r.key is None:
            out[r.metric] = r.value
        else:
            out.setdefault(r.metric, {})[r.key] = r.value
    _put(metrics.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True).encode())
    return out


def review_sheet(sample: DataFrame, path: str, blanks: tuple[str, ...] = ("tone", "rephrase", "note")) -> None:
    """A CSV file with a byte-order mark and empty columns to fill in; the sample is a
    review sample of a stated size."""
    import csv
    import io

    text = io.StringIO()
    sheet = csv.writer(text)
    sheet.writerow([*sample.columns, *blanks])
    for r in sample.collect():
        sheet.writerow([*("" if v is None else v for v in r), *("" for _ in blanks)])
    _put(sample.sparkSession, path, text.getvalue().encode("utf-8-sig"))


def seed_document(seeds: DataFrame, path: str, **header: object) -> None:
    """Seeds as JSON Lines with a header object beside them in <path>.header.json."""
    jsonl(seeds, path)
    head = dict(header) | {"total": seeds.count(), "base_topics": seeds.select("base_seed_id").distinct().count()}
    _put(seeds.sparkSession, f"{path}.header.json", json.dumps(head, ensure_ascii=False, indent=2).encode())


def shown(df: DataFrame, n: int = 20) -> str:
    """A console summary."""
    return df.limit(n).toPandas().to_string(index=False)


def full_outer_curves(a: DataFrame, b: DataFrame, on: str = "step") -> DataFrame:
    """Two curves (step, loss) side by side over all steps; '—' where one has none."""
    said = lambda c: F.coalesce(F.format_number(c, 4), F.lit("—"))
    both = a.withColumnRenamed("loss", "loss_a").join(b.withColumnRenamed("loss", "loss_b"), on, "full_outer")
    return both.select(on, said(F.col("loss_a")).alias("a"), said(F.col("loss_b")).alias("b"))
