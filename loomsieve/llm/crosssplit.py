"""Records of evaluation splits that also stand in the training split (problem 5).

Minwise hash shingles in banded buckets, cross-split candidates only, exact Jaccard
similarity, confirmed pairs counted by split and source. Records without a split, null
texts and texts without letters or digits don't count. Split names are compared
trimmed and in lower case. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import textform
from loomsieve.llm._pairs import Classes, across_classes, classes, hot_values, spread_join
from loomsieve.llm.nearpairs import class_links, settled
from loomsieve.llm.sketches import minwise
from loomsieve.storage import materialize

LIKENESS = 0.6
BANDS, ROWS = 40, 5


def _split(split_col: str) -> Column:
    return F.lower(F.trim(F.col(f"`{split_col}`")))


def _linked(df: DataFrame, id_col: str, fields: list[str], split_col: str, train: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, side, h, raw) of the texts, side 0 in training, and the links (a, b) from texts of
    side 0 to texts of side 1."""
    split = _split(split_col)
    ids = df.where(split.isNotNull() & (split != ""))
    both = ids.select(((F.col(f"`{id_col}`").cast("long") * 2) + F.when(split == train, 0).otherwise(1)).alias("id"), *(F.col(f"`{c}`") for c in fields))
    formed = textform.with_forms(textform.long_units(both, "id", fields), plain=False, keep_text=True).where("bare <> ''")
    units = formed.select(F.shiftright("id", 1).alias("id"), F.lit(0).alias("salt"), F.col("id").bitwiseAND(1).cast("int").alias("side"), F.xxhash64("bare").alias("h"), F.xxhash64(F.lit(11), "bare").alias("h2"), "bare", F.xxhash64("text").alias("raw"))
    units = settled(materialize(units, "units"))
    links = materialize(class_links(units, minwise, least=least, bands=BANDS, rows=ROWS, cross=True), "links")
    return units.select("id", "side", "h", "raw"), links


def _of_links(members: DataFrame, links: DataFrame, side: int, key: str) -> DataFrame:
    of = members.where(F.col("side") == side)
    return spread_join(of, links.select(F.col(key).alias("h")).distinct(), ["h"], hot_values(of.select("h"), "h"), "left_semi")


def cross_split_pairs(df: DataFrame, id_col: str, fields: list[str], split_col: str = "split", train: str = "train", least: float = LIKENESS) -> DataFrame:
    """Operator: (train_id, eval_id), every confirmed overlap of a training record and a
    record of another split, over all texts of ``fields`` against each other, in the form
    that ``_pairs`` states: a text with more than ``COPIES`` exact copies on a side is in
    class form there. ``overlap_counts`` counts all of them."""
    members, links = _linked(df, id_col, fields, split_col, train, least)

    def of(side: int, key: str) -> Classes:
        return classes(materialize(_of_links(members, links, side, key).select("h", "raw", "id"), "members"), ["h"], "raw")

    out = across_classes(links, of(0, "a"), of(1, "b"))
    return out.select(F.col("x").alias("train_id"), F.col("y").alias("eval_id")).distinct()


def overlap_counts(df: DataFrame, id_col: str, fields: list[str], split_col: str = "split", train: str = "train", least: float = LIKENESS) -> DataFrame:
    """Operator: (eval_id, n), to how many training records each evaluation record is
    linked, all copies counted, without making the pairs.

    Records with the same linked texts are one set with a size. The training records
    that some text of an evaluation record links are counted by inclusion and exclusion
    over its texts: those of each text, less those of each two, and so on. Tables grow
    with the sets and their links, never with two hot sides.
    """
    members, links = _linked(df, id_col, fields, split_col, train, least)
    sets = lambda side, key: _of_links(members, links, side, key).groupBy("id").agg(F.array_sort(F.collect_set("h")).alias("of"))
    evals = materialize(sets(1, "b"), "evals")
    trained = sets(0, "a").groupBy("of").agg(F.count("*").alias("m"))
    reached = materialize(trained.select("of", "m", F.explode("of").alias("a")).join(links, "a").select("of", "m", "b").distinct(), "reached")
    subsets = F.expr("aggregate(of, array(cast(array() as array<bigint>)), (s, x) -> concat(s, transform(s, t -> concat(t, array(x)))))")
    wanted = evals.select("of").distinct().select("of", F.explode(subsets).alias("t")).where("size(t) > 0")
    shared = wanted.where("size(of) > 1").select(F.explode("of").alias("b")).distinct()
    more = reached.join(shared, "b", "left_semi").select("of", "m", "b")
    count = lambda step: step.groupBy("t").agg(F.sum("m").alias("n"))
    counts, step = count(reached.select("m", F.array("b").alias("t"))), more.select("of", "m", F.array("b").alias("t"))
    for k in range(2, len(fields) + 1):
        longer = step.join(more.select("of", "b"), "of").where("b > element_at(t, -1)").select("of", "m", F.concat("t", F.array("b")).alias("t"))
        step = longer.join(wanted.where(F.size("t") == k).select("t").distinct(), "t", "left_semi").select("of", "m", "t")
        counts = counts.union(count(step))
    signed = F.when(F.size("t") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    n = wanted.join(counts, "t").groupBy("of").agg(F.sum(signed).alias("n"))
    return evals.join(n, "of").select(F.col("id").alias("eval_id"), "n")


def overlap_report(df: DataFrame, pairs: DataFrame, id_col: str, split_col: str = "split", source_col: str = "source") -> DataFrame:
    """Operator: (split, source, records, overlapping, pairs) of the evaluation splits.

    pairs: overlap_counts (eval_id, n), which counts every copy, or a list of pairs.
    records: rows with this split and source (null source is a source of its own);
    overlapping: those with a confirmed overlap; pairs: all their overlaps.
    """
    split = _split(split_col)
    rows = df.where(split.isNotNull() & (split != "") & (split != "train")).select(F.col(f"`{id_col}`").cast("long").alias("eval_id"), split.alias("split"), F.col(f"`{source_col}`").alias("source"))
    hits = pairs if "n" in pairs.columns else pairs.groupBy("eval_id").agg(F.count("*").alias("n"))
    joined = rows.join(hits, "eval_id", "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
