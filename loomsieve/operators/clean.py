"""Rule-based cleaning of answers, its accounting and its verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import patterns as P
from loomsieve.functions import text as T


def clean(df: DataFrame) -> DataFrame:
    """Adds cleaned (null: the row goes) to (task_type, user_text, answer).

    response: goes if prompt or answer asks for a photo; title: forbidden words are
    taken out, goes if under two characters remain; intro, ending: without emoji if
    anything remains; first_question: without greeting; retry: goes if it has forbidden
    or photo words; other tasks pass.
    """
    answer, prompt = F.col("answer"), F.coalesce(F.col("user_text"), F.lit(""))
    photo, forbidden = T.contains_any(answer, P.PHOTO_WORDS), T.contains_any(answer, P.FORBIDDEN_WORDS)
    title, plain = T.clean_title(answer), T.strip_emoji(answer)
    task = F.col("task_type")
    out = (
        F.when((task == "response") & (photo | T.contains_any(prompt, P.PHOTO_WORDS)), F.lit(None))
        .when((task == "title") & forbidden, F.when(F.length(title) >= 2, title))
        .when(task.isin("intro", "ending"), F.when(plain == "", answer).otherwise(plain))
        .when(task == "first_question", T.strip_greeting(answer))
        .when((task == "retry") & (forbidden | photo), F.lit(None))
        .otherwise(answer)
    )
    return df.withColumn("cleaned", out)


def accounting(cleaned: DataFrame) -> DataFrame:
    """(task_type, rows, deleted, modified)."""
    gone = F.col("cleaned").isNull() & F.col("answer").isNotNull()
    changed = F.coalesce(F.col("cleaned") != F.col("answer"), F.lit(False))
    return cleaned.groupBy("task_type").agg(F.count("*").alias("rows"), F.sum(gone.cast("long")).alias("deleted"), F.sum(changed.cast("long")).alias("modified"))


def verification(df: DataFrame, by: str = "split") -> DataFrame:
    """(split, photo, forbidden, emoji, greeting): what cleaned answers must not have."""
    x, task = F.col("cleaned"), F.col("task_type")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.where(x.isNotNull()).groupBy(by).agg(
        count((task == "response") & T.contains_any(x, P.PHOTO_WORDS)).alias("photo"),
        count((task == "title") & T.contains_any(x, P.FORBIDDEN_WORDS)).alias("forbidden"),
        count((task == "intro") & x.rlike(P.EMOJI_WIDE)).alias("emoji"),
        count((task == "first_question") & x.startswith("안녕")).alias("greeting"),
    )
