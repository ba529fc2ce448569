"""Scores of predictions: rates, issue lists, rule scores and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import patterns as P
from loomsieve.functions import text as T


def parsed(df: DataFrame) -> DataFrame:
    """Adds json_ok, keys_ok, comment and next_question of ``generated``. Any JSON value
    is JSON; only objects have keys; without them the fields are ''."""
    gen = F.coalesce(F.col("generated"), F.lit(""))
    out = df.withColumn("json_ok", T.is_json(gen))
    safe = F.when(F.col("json_ok"), gen)
    keys = F.col("json_ok") & T.has_key(safe, "comment") & T.has_key(safe, "next_question")
    out = out.withColumn("keys_ok", F.coalesce(keys, F.lit(False)))
    get = lambda k: F.when(F.col("json_ok"), T.json_text(safe, k)).otherwise(F.lit(""))
    return out.withColumn("comment", get("comment")).withColumn("next_question", get("next_question"))


def response_metrics(df: DataFrame) -> DataFrame:
    """Rates in percent over all rows, unparsable ones included; 0 for no rows."""
    both = F.concat("comment", "next_question")
    flags = {
        "json_parse_rate": F.col("json_ok"),
        "keys_present_rate": F.col("keys_ok"),
        "comment_length_ok": F.col("keys_ok") & F.length("comment").between(10, 100),
        "honorific_rate": F.col("keys_ok") & F.col("comment").rlike(P.HONORIFIC_FULL),
        "no_emoji_rate": F.col("keys_ok") & ~both.rlike(P.EMOJI_NARROW),
        "no_survey_word_rate": F.col("keys_ok") & ~T.contains_any(both, P.FORBIDDEN_WORDS),
    }
    n = F.count("*")
    return parsed(df).agg(*(F.coalesce(F.sum(c.cast("long")) * 100 / n, F.lit(0.0)).alias(k) for k, c in flags.items()), n.alias("total_evaluated"))


def non_empty_rates(df: DataFrame) -> DataFrame:
    """(task, total, non_empty): percent of answers with more than white space."""
    return df.groupBy("task").agg(F.count("*").alias("total"), (F.sum((~T.is_blank(F.col("generated"))).cast("long")) * 100 / F.count("*")).alias("non_empty"))


def _flag(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


def issues(df: DataFrame) -> DataFrame:
    """Adds issues (array, in a fixed order) and passed."""
    rows = parsed(df)
    comment, nq, gen = F.col("comment"), F.col("next_question"), F.coalesce(F.col("generated"), F.lit(""))
    safe = F.when(F.col("json_ok"), gen)
    response = F.array_compact(F.array(
        _flag(~T.has_key(safe, "comment"), "NO_COMMENT_KEY"), _flag(~T.has_key(safe, "next_question"), "NO_NEXT_Q_KEY"),
        _flag(~comment.rlike(P.HONORIFIC_RESPONSE), "NO_HONORIFIC_COMMENT"),
        *(_flag(F.concat(comment, nq).contains(w), f"FORBIDDEN_WORD:{w}") for w in P.FORBIDDEN_WORDS),
        *(_flag(nq.contains(w), f"PHOTO_REQUEST:{w}") for w in P.PHOTO_REQUESTS),
    ))
    retry = F.array_compact(F.array(_flag(~gen.rlike(P.HONORIFIC_RETRY), "NO_HONORIFIC")))
    found = (
        F.when(T.is_blank(gen), F.array(F.lit("EMPTY")))
        .when((F.col("task") == "response") & ~F.col("json_ok"), F.array(F.lit("JSON_PARSE_FAIL")))
        .when(F.col("task") == "response", response)
        .when(F.col("task") == "retry", retry)
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.withColumn("issues", found).withColumn("passed", F.size("issues") == 0)


def forceful_words(df: DataFrame) -> DataFrame:
    """After issues(): adds FORCEFUL issues, which fail, and a length note, which doesn't."""
    forced = F.array_compact(F.array(*(_flag(F.col("comment").contains(w), f"FORCEFUL:{w}") for w in P.FORCEFUL_WORDS)))
    note = F.array_compact(F.array(F.when(F.length("comment") > 100, F.format_string("COMMENT_TOO_LONG(%d)", F.length("comment")))))
    return df.withColumn("passed", F.col("passed") & (F.size(forced) == 0)).withColumn("issues", F.concat("issues", forced, note))


def _score(penalties: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    score = F.lit(5)
    for cond, points, _ in penalties:
        score = score - F.when(cond, points).otherwise(0)
    reasons = F.array_compact(F.array(*(_flag(c, r) for c, _, r in penalties)))
    return F.greatest(F.lit(1), F.least(F.lit(5), score)), F.when(F.size(reasons) == 0, F.lit("양호")).otherwise(F.array_join(reasons, ", "))


def tone_score(comment: Column) -> tuple[Column, Column]:
    """(score 1-5, reasons) of a comment."""
    n = F.length(comment)
    return _score([
        (~comment.rlike(P.HONORIFIC_FULL), 2, "존댓말 미사용"), (~T.contains_any(comment, P.EMPATHY_WORDS), 1, "공감표현 부족"),
        (n < 5, 1, "너무 짧음"), (n > 80, 1, "너무 김"), (T.contains_any(comment, P.TONE_FORBIDDEN), 2, "금지어 포함"),
        (T.contains_any(comment, P.PHOTO_REQUESTS), 1, "부적절 요청 포함"),
    ])


def rephrase_score(generated: Column, expected: Column, original: Column) -> tuple[Column, Column]:
    """(score 1-5, reasons) of a rephrased question against the expected one."""
    want, n = T.keywords(expected), F.length(generated)
    overlap = F.size(F.array_intersect(want, T.keywords(generated))) / F.greatest(F.size(want), F.lit(1))
    some = F.size(want) > 0
    context = F.concat_ws(" ", expected, original)
    odd = F.lit(False)
    for w in P.PHOTO_WORDS:
        odd = odd | (generated.contains(w) & ~context.contains(w))
    return _score([
        (~generated.rlike(P.HONORIFIC_REPHRASE), 2, "존댓말 미사용"), (n < 5, 2, "너무 짧음"), (n > 100, 1, "너무 김"),
        (some & (overlap < 0.2), 2, "의미 이탈"), (some & (overlap >= 0.2) & (overlap < 0.4), 1, "의미 약간 이탈"),
        (odd, 2, "부적절 요청(사진 등)"), (T.contains_any(generated, P.FORBIDDEN_WORDS), 2, "금지어 포함"),
    ])


def review(df: DataFrame) -> DataFrame:
    """(id, topic, user_answer, gen/exp comment and question, tone and rephrase scores
    with reasons) from (id, user_input, expected, generated)."""
    rows = df.select("id", F.coalesce("user_input", F.lit("")).alias("u"), F.coalesce("generated", F.lit("")).alias("g"), F.coalesce("expected", F.lit("")).alias("e"))
    rows = rows.withColumn("g_ok", T.is_json("g")).withColumn("e_ok", T.is_json("e"))
    part = lambda c, key, raw: F.when(F.col(f"{c}_ok"), T.json_text(F.when(F.col(f"{c}_ok"), F.col(c)), key)).otherwise(F.col(c) if raw else F.lit(""))
    rows = rows.select(
        "id", T.prompt_line(F.col("u"), 1, "주제: ").alias("topic"), T.prompt_line(F.col("u"), 3, "사용자 응답: ").alias("user_answer"), T.prompt_line(F.col("u"), 4, "다음 질문: ").alias("original"),
        part("g", "comment", True).alias("gen_comment"), part("g", "next_question", False).alias("gen_next_q"), part("e", "comment", True).alias("exp_comment"), part("e", "next_question", False).alias("exp_next_q"),
    )
    tone, why = tone_score(F.col("gen_comment"))
    again, why_again = rephrase_score(F.col("gen_next_q"), F.col("exp_next_q"), F.col("original"))
    return rows.select("*", tone.alias("tone_score"), why.alias("tone_reason"), again.alias("rephrase_score"), why_again.alias("rephrase_reason")).drop("original")


def score_summary(scored: DataFrame, score_col: str, needed: float) -> DataFrame:
    """(n, mean, passed, pass_rate, five, four, low, status)."""
    s = F.col(score_col)
    count = lambda c: F.sum(c.cast("long"))
    out = scored.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), count(s >= 4).alias("passed"), (count(s >= 4) * 100 / F.count(s)).alias("pass_rate"), count(s == 5).alias("five"), count(s == 4).alias("four"), count(s <= 3).alias("low"))
    return out.withColumn("status", F.when(F.col("pass_rate") >= needed, "PASS").otherwise("FAIL"))


def reason_histogram(scored: DataFrame, reason_col: str) -> DataFrame:
    """(reason, n) of all reasons but '양호'."""
    return scored.select(F.explode(F.split(reason_col, ", ")).alias("reason")).where("reason <> '양호'").groupBy("reason").agg(F.count("*").alias("n"))
