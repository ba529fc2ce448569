"""From classes of equal texts to pairs of records, without squares of hot classes.

A class of exact copies with more than ``COPIES`` members is given in class form: its
least member stands for it, and every other member is paired with that of its own class
(where copies are pairs) and of each linked class. All other records are paired with
each other. So no link between different texts is lost, and every record shows up in a
pair with each class it is linked to. Classes are told by an aggregation that combines
before the shuffle, never by a sort of a class in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.storage import materialize

#: Largest class of exact copies of which every two members are paired.
COPIES = 64
#: Members of one key that one task compares with as many others.
BLOCK = 1024
#: Parts in which a hot key is looked up.
SALTS = 32
#: A value with more than 1/HOT of the rows, and more than HOT_ROWS, is joined in PARTS.
HOT, HOT_ROWS, PARTS = 200, 100_000, 256


def looked_up(rows: DataFrame, few: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """Left join with a table of few rows; salted, so a hot key is spread over tasks."""
    few = few.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(few, [*by, "_s"], "left").drop("_s")


def hot_values(rows: DataFrame, key: str) -> list:
    """Values of ``key`` that hold more than 1/HOT of the rows: fewer than HOT of them,
    whatever the input. Null is none."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    most = max(rows.count() / HOT, HOT_ROWS)
    return [r[0] for r in counts.where(F.col("n") > most).select(key).collect()]


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], hot: list, how: str = "inner", id_col: str = "id") -> DataFrame:
    """rows joined with a table that has a row for each key; rows of the hot values of
    on[0] are salted, so that no task gets all of one value. The table grows with the
    rows, so it is never broadcast."""
    table = table.hint("merge")
    if not hot:
        return rows.join(table, on, how)
    is_hot = F.col(on[0]).isin(hot)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.withColumn("_s", F.when(is_hot, F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int")).otherwise(0))
    return salted.join(table.withColumn("_s", F.explode(parts)), [*on, "_s"], how).drop("_s")


@dataclass
class Classes:
    """speakers: members that are paired with all; late: the other members, with the
    first of their class, None where no class is hot; firsts: the least member of every
    class."""

    speakers: DataFrame
    late: DataFrame | None
    firsts: DataFrame


def classes(members: DataFrame, key: list[str], form: str) -> Classes:
    """members (*key, form, id), a written table: equal key and form make a class."""
    by = [*key, form]
    sizes = members.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    firsts = sizes.select(*by, F.col("first").alias("id"))
    hot = materialize(sizes.where(F.col("n") > COPIES).select(*by, "first"), "hot")
    if hot.isEmpty():
        return Classes(members.select(*by, "id"), None, firsts)
    told = materialize(looked_up(members, hot, by).select(*by, "id", "first"), "members")
    return Classes(told.where("first IS NULL OR id = first").select(*by, "id"), told.where("id <> first"), firsts)


def in_blocks(rows: DataFrame, key: list[str], id_col: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """(rows with the block of each, (*key, blocks) of the keys with more than one block
    or None)."""
    big = materialize(rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    if big.isEmpty():
        return rows.withColumn("block", F.lit(0)), None
    return looked_up(rows, big, key, id_col).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(id_col, F.lit(5)), F.col("blocks")).cast("int")).drop("blocks"), big


def met(rows: DataFrame, key: list[str], on: Column, id_col: str = "id") -> DataFrame:
    """Self-join of ``rows`` on ``key`` under aliases a and b with the condition ``on``;
    every two blocks of a hot key meet in a task of their own."""
    rows, big = in_blocks(rows, key, id_col)
    if big is None:
        i, j = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)), None
        j = i
    else:
        others = looked_up(rows, big, key, id_col).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        i = others.withColumnRenamed("block", "i").withColumnRenamed("other", "j")
        j = others.withColumnRenamed("block", "j").withColumnRenamed("other", "i")
    for k in [*key, "i", "j"]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return i.alias("a").join(j.alias("b"), on)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b) with id_a < id_b from (x, y)."""
    return pairs.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def within_classes(of: Classes, key: list[str], form: str, alike: bool) -> DataFrame:
    """(x, y): members that share ``key``; alike: also those of one form."""
    c = "id" if alike else form
    out = met(of.speakers, key, F.col(f"a.{c}") < F.col(f"b.{c}")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    if of.late is None:
        return out
    if alike:
        out = out.union(of.late.select(F.col("first").alias("x"), F.col("id").alias("y")))
    on = F.col(f"a.{form}") != F.col(f"b.{form}")
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return out.union(of.late.alias("a").join(of.firsts.alias("b"), on).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")))


def across_classes(links: DataFrame, left: Classes, right: Classes) -> DataFrame:
    """(x, y): members (h, id) of the texts a and b of each link."""

    def side(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.select(F.col("h").alias(name), F.col("id").alias(to)).hint("merge")

    def spread(df: DataFrame, rows: DataFrame, name: str, to: str) -> DataFrame:
        rows, big = in_blocks(rows, ["h"])
        if big is None:
            return df.join(side(rows, name, to), name)
        parts = df.join(big.select(F.col("h").alias(name), "blocks"), name, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        return parts.join(rows.select(F.col("h").alias(name), F.col("id").alias(to), "block").hint("merge"), [name, "block"]).drop("block")

    out = spread(spread(links, left.speakers, "a", "x"), right.speakers, "b", "y").select("x", "y")
    if left.late is not None:
        out = out.union(links.join(side(left.late, "a", "x"), "a").join(side(right.firsts, "b", "y"), "b").select("x", "y"))
    if right.late is not None:
        out = out.union(links.join(side(right.late, "b", "y"), "b").join(side(left.firsts, "a", "x"), "a").select("x", "y"))
    return out
