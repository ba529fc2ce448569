"""Groups of records that share most of a text (problem 2).

Fast similarity sketches, banding, exact verification. A record is one row; texts of
different fields are never compared. Null texts and texts without letters or digits
give no unit; equal bare forms are copies of one text. An empty table gives an empty
result; columns that aren't named aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import textform
from loomsieve.llm._pairs import across_classes, classes, hot_values, ordered_pairs, spread_join, within_classes
from loomsieve.llm.nearpairs import class_links, settled
from loomsieve.llm.sketches import fast_sketch
from loomsieve.storage import materialize

LIKENESS = 0.6
#: 40 bands of 5 coordinates: a pair is a candidate with probability .96 at a likeness
#: of .60, .99 at .65, .999 at .70.
BANDS, ROWS = 40, 5


def text_units(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, salt = field, side, h, bare, raw) of every text with letters or digits, written
    once into the shared folder as it is read several times."""
    units = textform.with_forms(textform.long_units(df, id_col, fields), plain=False, keep_text=True).where("bare <> ''")
    units = units.select("id", F.col("field").alias("salt"), F.lit(0).alias("side"), F.xxhash64("field", "bare").alias("h"), F.xxhash64(F.lit(11), "bare", "field").alias("h2"), "bare", F.xxhash64("text").alias("raw"))
    return settled(materialize(units, "units"))


def text_links(units: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(a, b): links between different texts, by their hashes."""
    return class_links(units, fast_sketch, least=least, bands=BANDS, rows=ROWS, cross=False)


def near_duplicates(df: DataFrame, id_col: str, fields: list[str], least: float = LIKENESS) -> DataFrame:
    """Operator: (id, field, class_id, copies, links), a row for each text of a record.

    class_id is the least id of the records with an equal text; copies their number;
    links how many different texts are alike.
    """
    units = text_units(df, id_col, fields)
    pairs = text_links(units, least)
    degree = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("h")).agg(F.count("*").alias("links"))
    texts = units.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(degree, "h", "left")
    names = F.array(*map(F.lit, fields))
    out = spread_join(units.select("id", "salt", "h"), texts, ["h"], hot_values(units.select("h"), "h"))
    return out.select("id", F.element_at(names, F.col("salt") + 1).alias("field"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(df: DataFrame, id_col: str, fields: list[str], least: float = LIKENESS) -> DataFrame:
    """(id_a, id_b): links of texts as pairs of records, in the form that ``_pairs``
    states: every pair, but a text with more than ``COPIES`` exact copies in class form.
    Texts of one bare form that differ in layout are all paired."""
    units = text_units(df, id_col, fields)
    pairs = materialize(text_links(units, least), "links")
    members = units.select("id", "h", "raw")
    copied = members.groupBy("h").count().where("count > 1").select("h")
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).union(copied).distinct()
    of = classes(materialize(spread_join(members, wanted, ["h"], hot_values(members, "h"), "left_semi"), "members"), ["h"], "raw")
    return ordered_pairs(within_classes(of, ["h"], "raw", alike=True).union(across_classes(pairs, of, of)))
