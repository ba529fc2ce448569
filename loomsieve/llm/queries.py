"""The queries of the problems on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.llm import crosssplit, groupsplit, language, ledger, mixing, neardup, oracles, packing, pairdefects, repetition, textform, tokens
from loomsieve.storage import drop, new_path

RECORDS, SAMPLES, LINES, DOCUMENTS = "generate_data_v3", "eval_samples", "raw_lines", "documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage of every generated answer."""
    return repetition.repetition_coverage(table(spark, sf_dir, SAMPLES), "sample_id", "generated").withColumnRenamed("id", "sample_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_repetition(spark, sf_dir).where("share_8 >= 0.4").select("sample_id")


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and titles in plain form."""
    out = textform.unify_text(table(spark, sf_dir, RECORDS), "ord", ["comment", "title"])
    return out.select(out.id.alias("ord"), "field", "plain", "changed")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = textform.lookalike_pairs(table(spark, sf_dir, RECORDS), "ord", ["comment", "title"])
    return out.select(out.id_a.alias("ord_a"), out.id_b.alias("ord_b"))


def p2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment, message and retry_message with its class of copies and its links."""
    out = neardup.near_duplicates(table(spark, sf_dir, RECORDS), "ord", ["comment", "message", "retry_message"])
    return out.withColumnRenamed("id", "ord")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicate_pairs(table(spark, sf_dir, RECORDS), "ord", ["comment", "message", "retry_message"])
    return out.select(out.id_a.alias("ord_a"), out.id_b.alias("ord_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crosssplit.cross_split_pairs(table(spark, sf_dir, RECORDS), "ord", ["comment", "message"])
    return out.select(F.least("train_id", "eval_id").alias("ord_a"), F.greatest("train_id", "eval_id").alias("ord_b")).distinct()


def p5_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed cross-split overlaps by split and source."""
    records = table(spark, sf_dir, RECORDS)
    return crosssplit.overlap_report(records, crosssplit.overlap_counts(records, "ord", ["comment", "message"]), "ord")


def _batches(df: DataFrame, at: str, tenths: int = 5) -> list[DataFrame]:
    """The rows in the order of their arrival, as two batches: those of the first tenths
    of the time from the first to the last (and those without a time), and the later."""
    r = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).selectExpr(f"lo + (hi - lo) * {tenths} / 10 AS middle").first()
    late = F.coalesce(F.col(at) > F.lit(r.middle), F.lit(False))
    return [df.where(~late), df.where(late)]


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[ledger.Ledger, DataFrame]:
    records = [ledger.text_keys(b, "ord", ["title", "retry_message"]) for b in _batches(table(spark, sf_dir, RECORDS), "ingested_at")]
    lines = [ledger.json_keys(b, "line_id", "payload", "raw_line") for b in _batches(table(spark, sf_dir, LINES), "received_at")]
    return ledger.collapse(spark, [r.unionByName(x) for r, x in zip(records, lines, strict=True)])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.copies(*_ledger(spark, sf_dir))


def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each set of copies with the number of its copies."""
    return _ledger(spark, sf_dir)[0].rows().select("place", "first_id", "copies")


def _records_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, keys, stratum, split, ingested_at): the key of a record is its base seed, or
    its seed where it has none, or else the record itself."""
    base = groupsplit.clean_key(F.col("base_seed_id"))
    named = F.when(base != "", F.concat(F.lit("base:"), base)).when(F.col("seed_id").isNotNull(), F.concat(F.lit("seed:"), "seed_id")).otherwise(F.concat(F.lit("record:"), F.col("ord").cast("string")))
    stratum = F.regexp_replace(groupsplit.clean_key(F.col("task_type")), "[ -]+", "_")
    return table(spark, sf_dir, RECORDS).select(F.col("ord").alias("id"), F.array(named).alias("keys"), stratum.alias("stratum"), F.lower(F.trim("split")).alias("split"), "ingested_at")


def _components(spark: SparkSession, sf_dir: str) -> tuple[groupsplit.Components, DataFrame]:
    """The component table after two batches, a large one and a later delivery, and all
    records. Seeds join the first as links of a seed to its base seed, without a record
    of their own."""
    records = _records_of_split(spark, sf_dir)
    base = groupsplit.clean_key(F.col("base_seed_id"))
    seeds = table(spark, sf_dir, "seed").where(base != "").select(F.lit(None).cast("long").alias("id"), F.array(F.concat(F.lit("seed:"), "seed_id"), F.concat(F.lit("base:"), base)).alias("keys"), F.lit(None).cast("string").alias("stratum"), F.lit(None).cast("string").alias("split"))
    targets = {r.split: r.share for r in table(spark, sf_dir, "split_targets").collect()}
    out = groupsplit.Components(spark, new_path(spark, "splits"))
    first, second = (b.drop("ingested_at") for b in _batches(records, "ingested_at", 9))
    for batch in (first.unionByName(seeds), second):
        drop(out.add(batch, targets, keep_present=False))
    return out, records


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _components(spark, sf_dir)[0].rows().where("size(splits) > 1 AND key LIKE 'base:%'")
    return known.select(F.substring("key", 6, 1 << 30).alias("base_seed_id"))


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record."""
    components, records = _components(spark, sf_dir)
    return components.assigned(records).withColumnRenamed("id", "ord")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares of the splits, overall (stratum null) and for each task type."""
    rows = p6_assignment(spark, sf_dir).groupBy("stratum", "split").agg(F.count("*").alias("records"))
    both = rows.groupBy("split").agg(F.sum("records").alias("records")).select(F.lit(None).cast("string").alias("stratum"), "split", "records").union(rows)
    return both.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy("stratum")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, SAMPLES)
    tagger = language.fit_tagger(table(spark, sf_dir, DOCUMENTS), "doc_id", "text", "lang", _codes(spark, sf_dir))
    return pairdefects.defective_pairs(samples, "sample_id", "task", "user_input", ["generated", "expected"], tagger).withColumnRenamed("id", "sample_id")


def p7_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("field", "defect").agg(F.count("*").alias("answers"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of each text, or piece of a text, for each container."""
    sizes = tokens.token_sizes(table(spark, sf_dir, DOCUMENTS), "doc_id", "text")
    containers = table(spark, sf_dir, "pack_targets").withColumnRenamed("capacity_tokens", "capacity")
    return packing.pack(sizes, containers).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of each container against the least that could be."""
    return packing.fill_report(p8_packing(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.token_sizes(table(spark, sf_dir, DOCUMENTS), "doc_id", "text", ["source"])
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, sf_dir)[1]


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of p6_assignment: every record once, no component in two splits, every
    record with a split, the shares of the targets give or take two hundredths."""
    rows = p6_assignment(spark, sf_dir)
    parts = rows.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"), *(F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "val", "test")))
    want = {r.split: r.share for r in table(spark, sf_dir, "split_targets").collect()}
    near = F.lit(True)
    for s in ("train", "val", "test"):
        near = near & (F.abs(F.sum(s) / F.sum("n") - want.get(s, 0.0)) < 0.02)
    return parts.agg(F.sum("n").alias("records"), F.sum((F.col("splits") > 1).cast("long")).alias("components_in_two_splits"), (F.sum("n") - F.sum("train") - F.sum("val") - F.sum("test")).alias("without_split"), near.alias("near_shares"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of p8_packing for each container: every document, no bin over its
    capacity, no text cut that would have fitted."""
    rows = p8_packing(spark, sf_dir)
    bins = rows.where("bin IS NOT NULL").groupBy("container", "capacity", "bin").agg(F.sum("size").alias("t")).groupBy("container").agg(F.sum((F.col("t") > F.col("capacity")).cast("long")).alias("over_full"))
    texts = rows.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("t"))
    texts = texts.groupBy("container").agg(F.count("*").alias("documents"), F.sum(((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))).cast("long")).alias("cut_needlessly"))
    return texts.join(bins, "container").select("container", "documents", "over_full", "cut_needlessly")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of p9_copies: every document once, none used more often than allowed
    or though its source isn't listed, the shares of the targets that have documents
    give or take three per cent of them."""
    copies, report = _mixed(spark, sf_dir)
    caps = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    of = copies.join(F.broadcast(caps), "source", "left")
    use = of.agg(F.count("*").alias("documents"), F.sum((F.col("copies") > F.col("max_repeats")).cast("long")).alias("over_cap"), F.sum((F.col("max_repeats").isNull() & (F.col("copies") > 0)).cast("long")).alias("unlisted_used"))
    there = report.where("documents > 0").agg(F.sum("target_share").alias("whole"))
    near = report.where("documents > 0").join(F.broadcast(there)).agg(F.bool_and(F.abs(F.col("actual_share") * F.col("whole") / F.col("target_share") - 1) < 0.03).alias("near_shares"))
    return use.join(F.broadcast(near))


def _codes(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return {r.lang: r.name for r in table(spark, sf_dir, "lang_codes").collect()}


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language with a confidence for each document and each line of a mixed one."""
    docs, codes = table(spark, sf_dir, DOCUMENTS), _codes(spark, sf_dir)
    tagger = language.fit_tagger(docs, "doc_id", "text", "lang", codes)
    return language.tag_languages(docs, "doc_id", "text", "lang", codes, tagger).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(p10_languages(spark, sf_dir).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_repetition, p2_found, p2_near_duplicates, p3_found, p3_ledger, p4_found, p4_unified, p5_found, p5_overlap_report, p6_found, p6_assignment, p6_shares, p6_checks, p7_found, p7_defect_counts, p8_packing, p8_fill, p8_checks, p9_copies, p9_shares, p9_checks, p10_found, p10_languages]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the rest is tested against brute force."""
    return oracles.all_sql()
