"""Reading JSON Lines, splits, legacy versions, JSON documents, configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomsieve.functions import text as T

SPLITS = ("train", "val", "test")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema: S.StructType | str, ordinal: str | None = None) -> DataFrame:
    """Strict JSON Lines: a bad line raises. ordinal: adds the line's place over all
    files in name order; only then are partitions counted first."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not ordinal:
        return df
    kinds = df.schema
    numbered = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return spark.createDataFrame(numbered, S.StructType([*kinds.fields, S.StructField(ordinal, S.LongType())]))


def splits(spark: SparkSession, folder: str, schema: S.StructType | str) -> DataFrame:
    """All of train, val and test that exist, tagged; else raw_all as split 'all'; else
    FileNotFoundError."""
    found = [(s, f"{folder}/{s}.jsonl") for s in SPLITS if exists(spark, f"{folder}/{s}.jsonl")]
    if not found and exists(spark, f"{folder}/raw_all.jsonl"):
        found = [("all", f"{folder}/raw_all.jsonl")]
    if not found:
        raise FileNotFoundError(f"no splits and no raw_all.jsonl in {folder}")
    out = None
    for name, path in found:
        df = jsonl(spark, path, schema).withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def legacy_texts(chatml: DataFrame) -> DataFrame:
    """(task_type, norm): normalised answers of an older version; a response's JSON
    gives its two texts on two lines, or itself if it isn't valid."""
    raw = F.element_at("messages", -1)["content"]
    rows = chatml.select("task_type", raw.alias("raw")).withColumn("ok", T.is_json("raw"))
    safe = F.when(F.col("ok"), F.col("raw"))
    said = F.concat_ws("\n", T.json_text(safe, "comment"), T.json_text(safe, "next_question"))
    text = F.when((F.col("task_type") == "response") & F.col("ok"), said).otherwise(F.col("raw"))
    return rows.select("task_type", T.normal_general(text).alias("norm"))


def json_document(spark: SparkSession, path: str, schema: S.StructType | str | None = None) -> DataFrame:
    """A whole file as one JSON value (an array gives a row for each element)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An inline table."""
    return spark.createDataFrame(rows, schema)


def line_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, rows) of the files that match, by name."""
    lines = spark.read.text(pattern).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    return lines.groupBy("file").agg(F.count("*").alias("rows")).orderBy("file")


def config(path: str) -> dict:
    """Nested configuration: JSON, or YAML where a parser is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)
