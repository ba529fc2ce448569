"""Text columns: normal forms, predicates, shingles. Native expressions except for NFC
and strict JSON, which are Arrow-batched."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from loomsieve.functions import patterns as P

@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; most texts are composed already, which is quick to tell."""

    def compose(t: str) -> str:
        return t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)

    return texts.map(compose, na_action="ignore")


@F.pandas_udf(BooleanType())
def is_json(texts: pd.Series) -> pd.Series:
    """True if the whole text is one JSON value; null stays null."""

    def valid(t: str | None) -> bool | None:
        if t is None:
            return None
        try:
            json.loads(t)
        except (ValueError, RecursionError):
            return False
        return True

    return texts.map(valid, na_action=None)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, P.STRIP, "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return ~F.coalesce(c.rlike(P.NOT_SPACE), F.lit(False))


def normal_general(c: Column) -> Column:
    """NFC, stripped, runs of white space as one space."""
    return F.regexp_replace(strip(nfc(c)), P.SPACE + "+", " ")


def normal_hash(c: Column) -> Column:
    """NFC without white space and common marks, lower case. Texts of marks only all
    give ''."""
    return F.lower(F.regexp_replace(nfc(c), P.HASH_DROPPED, ""))


def normal_quality(c: Column) -> Column:
    return strip(nfc(c))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def base_seed(c: Column) -> Column:
    return F.regexp_replace(c, P.VERSION_ENDINGS, "")


def clean_task(c: Column) -> Column:
    """Task name in one spelling: stripped, lower case, underscores."""
    return F.regexp_replace(F.lower(strip(c)), "[ -]+", "_")


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def words(c: Column) -> Column:
    """Tokens between white space; [] for blank text."""
    return F.filter(F.split(c, P.SPACE + "+"), lambda x: x != "")


def with_tokens(df: DataFrame, c: Column, name: str = "w") -> DataFrame:
    """Adds the words of ``c``. A generator holds them, so that they are split once for a
    row: as a plain column they would be inlined, and split again, wherever used."""
    return df.select("*", F.explode(F.array(words(c))).alias(name))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(normal_quality(c)), 1, n), " ")


def word_shingles(tokens: Column, n: Column | int) -> Column:
    """Distinct runs of n tokens; all tokens as one if there are fewer, [] if none."""
    k = F.lit(n) if isinstance(n, int) else n
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def strip_emoji(c: Column) -> Column:
    return strip(F.regexp_replace(c, P.EMOJI_WIDE, ""))


def strip_greeting(c: Column) -> Column:
    out = strip_emoji(strip(F.regexp_replace(c, P.GREETING, "")))
    return F.when(out == "", c).otherwise(out)


def clean_title(c: Column) -> Column:
    for w in P.FORBIDDEN_WORDS:
        c = strip(F.replace(c, F.lit(w), F.lit("")))
    return strip(F.regexp_replace(c, P.SPACE + "+", " "))


def strip_think(c: Column) -> Column:
    """Without reasoning blocks."""
    return strip(F.regexp_replace(c, P.THINK, ""))


def keywords(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({P.KEYWORD})")))


def json_text(c: Column, key: str) -> Column:
    """String value of a key of a valid JSON object, '' if it is null or missing."""
    return F.coalesce(F.get_json_object(c, f"$.{key}"), F.lit(""))


def has_key(c: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def prompt_line(c: Column, n: int, label: str) -> Column:
    """The n-th line (from 1) of a prompt without its label; '' if there is none."""
    return F.coalesce(F.replace(F.try_element_at(F.split(c, "\n"), F.lit(n)), F.lit(label), F.lit("")), F.lit(""))


def stage_bucket(index: Column) -> Column:
    return F.when(index <= 1, "early").when(index <= 4, "mid").otherwise("late")


def cyclic_pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def hashed_pick(values: list[str], key: Column, salt: int) -> Column:
    """A repeatable choice for each key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill {name} placeholders; null fills as ''."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out
