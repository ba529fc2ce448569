"""Copies hidden by layout: an incremental ledger of canonical keys (problem 3).

The canonical key of a text is its bare form (letters and digits of the consistent
form, lower case); that of a JSON object is its sorted members with bare strings. The
ledger keeps, in hash buckets, one row for each key: place, copies so far and the
earliest representative. A batch is aggregated first (map-side too, so a hot key is one
row for each task). It is full-outer-joined with the buckets it touches, adding counts
and keeping the least id, and written as a new version of those; the others stay where
they are. A batch that is small beside the ledger is only appended at first, and joined
with a bucket once what waits there is a quarter of it, so that small batches don't
rewrite the whole. The number of buckets doubles as keys are added.

A ledger lives in a named folder, version after version (``versions``), and goes on from
there in a later session.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm import textform
from loomsieve.llm._pairs import hot_values, spread_join
from loomsieve.llm.versions import Versions
from loomsieve.storage import materialize, new_path

#: Buckets of a new ledger, keys of a bucket at which their number doubles, and the share
#: of a bucket's keys that may wait before they are joined with it.
BUCKETS, FULL, WAIT = 16, 2_000_000, 0.25


def _keyed(df: DataFrame, place: object, text: str) -> DataFrame:
    return df.select(place.alias("place"), "id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), text, F.length(text)).alias("k2"))


def text_keys(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(place, id, k1, k2) of the texts of ``fields``; place is the field's name. Null
    texts and texts without letters or digits have no key."""
    formed = textform.with_forms(textform.long_units(df, id_col, fields), plain=False).where("bare <> ''")
    return _keyed(formed, F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1), "bare")


def _no_constant(x: str) -> None:
    raise ValueError(x)


def _canonical(objects: list[dict | None]) -> list[str | None]:
    """Members in order of their names, strings in bare form, numbers by their value."""
    strings: list[str] = []

    def gather(x: object) -> None:
        if isinstance(x, str):
            strings.append(x)
        elif isinstance(x, dict):
            [gather(v) for v in x.values()]
        elif isinstance(x, list):
            [gather(v) for v in x]

    for o in objects:
        gather(o)
    distinct = list(dict.fromkeys(strings))
    bare = {}
    if distinct:
        batch = pa.RecordBatch.from_pydict({"i": range(len(distinct)), "x": pa.array(distinct, pa.string())})
        for b in textform.run_sql([batch], f"SELECT i, {textform.bare_of_plain_sql(textform.plain_sql('x'))} AS b FROM batch"):
            bare.update((distinct[i], s) for i, s in zip(b["i"].to_pylist(), b["b"].to_pylist(), strict=True))

    def form(x: object) -> object:
        if isinstance(x, str):
            return bare[x]
        if isinstance(x, dict):
            return {k: form(v) for k, v in x.items()}
        if isinstance(x, list):
            return [form(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return [None if o is None else json.dumps(form(o), sort_keys=True, ensure_ascii=False) for o in objects]


def json_keys(df: DataFrame, id_col: str, payload_col: str, place: str) -> DataFrame:
    """(place, id, k1, k2) of the lines that are one valid JSON object; others, and
    nulls, have no key."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            objects: list[dict | None] = []
            for t in b["text"].to_pylist():
                try:
                    o = json.loads(t, parse_constant=_no_constant)
                except (ValueError, TypeError, RecursionError):
                    o = None
                objects.append(o if isinstance(o, dict) else None)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(_canonical(objects), pa.string())], names=["id", "form"])

    lines = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{payload_col}`").cast("string").alias("text"))
    return _keyed(lines.mapInArrow(read, "id long, form string").where("form IS NOT NULL"), F.lit(place), "form")


class Ledger:
    """Counts of canonical keys in a named folder, which is made or opened:
    (place, k1, k2, copies, first_id), a row for each key."""

    columns = "place string, k1 long, k2 long, copies long, first_id long"
    schema = columns + ", bucket int"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        """buckets: of a new ledger; an existing one has its own."""
        self.spark, self.store = spark, Versions(spark, folder)
        # joined, waiting: for each bucket [folder, keys] and a list of them
        self.state = self.store.state or {"buckets": buckets, "joined": {}, "waiting": {}}

    def _scan(self, parts: list[tuple[int, str]]) -> DataFrame:
        by: dict[str, list[int]] = {}
        for bucket, folder in parts:
            by.setdefault(folder, []).append(bucket)
        out = self.spark.createDataFrame([], self.schema)
        for folder, own in by.items():
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(self.store.at(folder)).where(F.col("bucket").isin(own)))
        return out

    def _joined(self, buckets: set[int]) -> DataFrame:
        return self._scan([(int(b), f) for b, (f, _) in self.state["joined"].items() if int(b) in buckets])

    def _waiting(self, buckets: set[int]) -> DataFrame:
        parts = [(int(b), f) for b, of in self.state["waiting"].items() if int(b) in buckets for f, _ in of]
        return self._summed(self._scan(parts))

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", "place", "k1", "k2").agg(F.sum("copies").alias("copies"), F.min("first_id").alias("first_id"))

    def _merged(self, buckets: set[int]) -> DataFrame:
        """The buckets with what waits in them."""
        both = self._joined(buckets).alias("o").join(self._waiting(buckets).alias("n"), ["bucket", "place", "k1", "k2"], "full_outer")
        return both.select("place", "k1", "k2", (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"), F.least("o.first_id", "n.first_id").alias("first_id"), "bucket")

    def _write(self, rows: DataFrame, name: str) -> dict[str, list]:
        """{bucket: [folder, keys]} of rows written by bucket."""
        folder = self.store.new_folder(name)
        rows.repartition(self.state["buckets"], "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(self.store.at(folder))
        written = self.spark.read.schema(self.schema).parquet(self.store.at(folder)).groupBy("bucket").count().collect()
        return {str(r.bucket): [folder, r["count"]] for r in written}

    def _commit(self) -> None:
        folders = {f for f, _ in self.state["joined"].values()} | {f for of in self.state["waiting"].values() for f, _ in of}
        self.store.commit(self.state, folders)

    def _bucket(self) -> Column:
        return F.pmod("k1", F.lit(self.state["buckets"])).cast("int").alias("bucket")

    def rows(self) -> DataFrame:
        """The whole ledger."""
        every = set(range(self.state["buckets"]))
        out = self._merged(every) if self.state["waiting"] else self._joined(every)
        return out.drop("bucket")

    def apply(self, keys: DataFrame) -> None:
        """Add a batch of (place, id, k1, k2). A batch with no keys changes nothing."""
        batch = keys.groupBy("place", "k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).withColumn("bucket", self._bucket())
        self.state = json.loads(json.dumps(self.state))
        written = self._write(batch.select("place", "k1", "k2", "copies", "first_id", "bucket"), "batch")
        if not written:
            return
        for b, part in written.items():
            if b in self.state["joined"]:
                self.state["waiting"].setdefault(b, []).append(part)
            else:
                self.state["joined"][b] = part
        due = {int(b) for b, of in self.state["waiting"].items() if sum(n for _, n in of) > WAIT * self.state["joined"][b][1]}
        if due:
            self.state["joined"].update(self._write(self._merged(due), "joined"))
            self.state["waiting"] = {b: of for b, of in self.state["waiting"].items() if int(b) not in due}
        keys_ = sum(n for _, n in self.state["joined"].values())
        if keys_ > FULL * self.state["buckets"]:
            rows = self.rows()
            while keys_ > FULL * self.state["buckets"]:
                self.state["buckets"] *= 2
            self.state["joined"], self.state["waiting"] = self._write(rows.withColumn("bucket", self._bucket()), "joined"), {}
        self._commit()


def collapse(spark: SparkSession, batches: list[DataFrame], buckets: int = BUCKETS, folder: str | None = None) -> tuple[Ledger, DataFrame]:
    """Operator: run the batches of keys through the ledger in ``folder`` (by default a
    new one that ends with the interpreter). Returns the ledger and all keys of the
    batches, written once, to look copies up with."""
    ledger, kept = Ledger(spark, folder or new_path(spark, "ledger"), buckets), []
    for b in batches:
        kept.append(materialize(b, "keys"))
        ledger.apply(kept[-1])
    keys = kept[0]
    for k in kept[1:]:
        keys = keys.unionByName(k)
    return ledger, keys


def copies(ledger: Ledger, keys: DataFrame) -> DataFrame:
    """(place, first_id, copy_id), a row for each member of a set but the first."""
    several = ledger.rows().where("copies > 1").select("place", "k1", "k2", "first_id")
    return spread_join(keys, several, ["k1", "k2", "place"], hot_values(keys.select("k1"), "k1")).where("id <> first_id").select("place", "first_id", F.col("id").alias("copy_id"))
