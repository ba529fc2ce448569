"""Where intermediate tables live.

Lineage is cut by writing a table into the folder all executors share. A cluster
names it in ``spark.checkpoint.dir``; only where that is unset and the master is one
process (tests) is a temporary folder made. Nothing is kept in executor-local storage,
so a lost executor never loses a table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session; set here only where it is unset and all tasks
    run in this process. On a cluster each executor would write to a disk of its own, so
    there a missing setting is a RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomsieve-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once no plan that still has to run reads it;
    other tables are left alone. Loops so keep the tables of one round only."""
    for t in tables:
        if path := t.__dict__.pop("_stored", None):
            _delete(t.sparkSession, path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored"] = path
    return out
