"""Seed expansion: topics x personas x occasions, questions, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.functions import text as T
from loomsieve.storage import materialize

#: Effective stride over the topics from slot to slot.
STRIDE = 18


def hash_ordinal(df: DataFrame, key_col: str, name: str = "ordinal") -> DataFrame:
    """Adds the place (from 0) of each row in the order of md5(key), key.

    The first two digits of the hash cut the order into 256 even parts, numbered on
    their own and shifted by the sizes of the parts before; no window holds all rows.
    """
    rows = df.withColumn("_h", F.md5(F.col(key_col))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    shift = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key_col))
    return rows.withColumn("_o", own).join(F.broadcast(shift), "_b").withColumn(name, F.col("_o") + F.col("_s") - 1).drop("_h", "_b", "_o", "_s")


def canonical_topics(seeds: DataFrame, order_col: str = "seed_id") -> DataFrame:
    """One row for each topic, the one with the shortest seed_id, then the least order."""
    first = seeds.groupBy("topic").agg(F.min_by("seed_id", F.struct(F.length("seed_id"), F.col(order_col))).alias("seed_id"))
    return seeds.join(first, ["topic", "seed_id"], "left_semi").dropDuplicates(["topic"])


def combos(personas: DataFrame, occasions: DataFrame) -> DataFrame:
    """(combo, persona_id, occasion_id, target_audience) of all pairs of two dimensions."""
    p = personas.select(F.lit(1).alias("one"), F.col("id").alias("persona_id"), F.col("name").alias("p_name"))
    o = F.broadcast(occasions.select(F.lit(1).alias("one"), F.col("id").alias("occasion_id"), F.col("name").alias("o_name")))
    both = p.join(o, "one")
    number = F.row_number().over(Window.orderBy("persona_id", "occasion_id")) - 1
    return both.select(number.alias("combo"), "persona_id", "occasion_id", F.concat_ws(" / ", "p_name", "o_name").alias("target_audience"))


def expand(topics: DataFrame, personas: DataFrame, occasions: DataFrame, slots: int = 10) -> DataFrame:
    """Seeds: slot i of combo c takes topic (c + 18 i) mod N in hash order."""
    ordered = hash_ordinal(topics, "topic")
    n = topics.count()
    if not n:
        return ordered.limit(0)
    slot = combos(personas, occasions).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    slot = slot.withColumn("ordinal", F.pmod(F.col("combo") + STRIDE * F.col("slot"), F.lit(n)).cast("long"))
    out = ordered.withColumn("ordinal", F.col("ordinal").cast("long")).join(F.broadcast(slot), "ordinal")
    number = F.col("combo") * slots + F.col("slot")
    new_id = F.format_string("%s_%s%s_%04d", F.split("seed_id", "_")[0], F.col("persona_id"), F.col("occasion_id"), number)
    return out.select(new_id.alias("seed_id"), T.base_seed(F.col("seed_id")).alias("base_seed_id"), slot.persona_id, slot.occasion_id, "topic", slot.target_audience, "domain")


def question_pairs(seeds: DataFrame) -> DataFrame:
    """(seed_id, question_index, current_question, next_question): every question with
    the one after it, from the array alone."""
    q, n = F.col("questions.content"), F.size("questions")
    pairs = F.arrays_zip(F.slice(q, F.lit(1), n - 1).alias("current_question"), F.slice(q, F.lit(2), n - 1).alias("next_question"))
    return seeds.where(n > 1).select("seed_id", F.posexplode(pairs).alias("question_index", "p")).select("seed_id", "question_index", "p.current_question", "p.next_question")


def sampled_values(df: DataFrame, key_col: str, values: list[str], k: int, name: str = "value") -> DataFrame:
    """k of the values for each row, in hash order of key and value."""
    order = F.array_sort(F.transform(F.array(*map(F.lit, values)), lambda v: F.struct(F.md5(F.concat_ws("|", F.col(key_col), v)).alias("h"), v.alias("v"))))
    return df.withColumn(name, F.explode(F.slice(F.transform(order, lambda x: x["v"]), 1, k)))


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def usage_stats(seeds: DataFrame, by: list[str]) -> DataFrame:
    """(groups, least, most, mean) of rows for each different ``by``."""
    c = seeds.groupBy(*by).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def repeatable_sample(df: DataFrame, key_col: str, n: int, salt: int = 42) -> DataFrame:
    """n rows in hash order of the key (a sampling operator; a top-k, no full sort)."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(salt), F.col(key_col).cast("string"))), key_col).limit(n)


def replies_to_records(replies: DataFrame, reply_col: str, text_col: str, seed_cols: list[str], max_length: int | None = None) -> DataFrame:
    """Raw JSON replies as records: an object gives its first list (or itself), strings
    and objects with ``text_col`` give a row, blank or over-long texts none."""
    r = F.col(reply_col)
    items = F.coalesce(F.from_json(r, f"array<struct<{text_col}: string>>"), F.array(F.from_json(r, f"struct<{text_col}: string>")))
    plain = F.from_json(r, "array<string>")
    inner = F.get(F.filter(F.map_values(F.from_json(r, f"map<string, array<struct<{text_col}: string>>>")), lambda x: x.isNotNull()), 0)
    texts = F.coalesce(F.filter(F.transform(inner, lambda x: x[text_col]), lambda x: x.isNotNull()), F.filter(F.transform(items, lambda x: x[text_col]), lambda x: x.isNotNull()))
    texts = F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, texts).otherwise(plain)
    out = replies.select(*seed_cols, F.explode(texts).alias(text_col)).withColumn(text_col, T.strip(F.col(text_col))).where(F.col(text_col) != "")
    return out.where(F.length(text_col) <= max_length) if max_length else out


def records_of_replies(replies: DataFrame, reply_col: str, keys: list[str], keep_cols: list[str], strip: bool = True) -> DataFrame:
    """Raw JSON replies whose records need several ``keys``: an object gives its first
    list or itself, an array its objects; objects that lack a key give no row. strip:
    values without blanks around them, and no row where the first key's is blank (the
    later format); else as they came (the first one). Replies that aren't JSON give none."""
    r = F.when(T.is_json(F.col(reply_col)), F.col(reply_col))
    one, many = "map<string, string>", "array<map<string, string>>"
    wrapped = F.get(F.filter(F.transform(F.map_values(F.from_json(r, one)), lambda v: F.when(v.startswith("["), F.from_json(v, many))), lambda x: x.isNotNull()), 0)
    items = F.when(F.trim(r).startswith("["), F.from_json(r, many)).otherwise(F.coalesce(wrapped, F.array(F.from_json(r, one))))
    rows = replies.select(*keep_cols, F.explode(items).alias("_m")).where(F.col("_m").isNotNull())
    for k in keys:
        rows = rows.where(F.map_contains_key("_m", k))
    out = rows.select(*keep_cols, *(T.strip(F.col("_m")[k]).alias(k) if strip else F.col("_m")[k].alias(k) for k in keys))
    return out.where(F.coalesce(F.col(keys[0]), F.lit("")) != "") if strip else out


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row (from 1) in the order of ``order``: numbered within
    range partitions and shifted by the sizes of those before, so no task holds all."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_p", before.alias("_s"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_o", own).join(F.broadcast(shift), "_p").withColumn(name, F.col("_o") + F.col("_s")).drop("_p", "_o", "_s")


def zip_by_place(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], name: str = "place") -> DataFrame:
    """The i-th row of a beside the i-th row of b, by the orders given; ValueError unless
    both have as many rows. Columns must not share names."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows can't be matched with {m}")
    return numbered(a, order_a, name).join(numbered(b, order_b, name), name)
