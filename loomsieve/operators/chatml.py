"""Records as arrays of role/content messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import text as T
from loomsieve.operators.tasks import TASKS, _switch, with_clean_task

CARRIED = ["task_type", "seed_id", "base_seed_id", "persona_id", "occasion_id"]


def _part(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def json_string(c: Column) -> Column:
    """``c`` as a JSON string literal, other than ASCII kept."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")


def user_text() -> Column:
    """The prompt of each task from its labelled lines."""
    return _switch({t: F.concat_ws("\n", *(F.concat(F.lit(label), _part(c)) for label, c in s.prompt)) for t, s in TASKS.items()}, F.lit(None).cast("string"))


def assistant_text() -> Column:
    """The answer; for response a JSON object with a space after ':' and ','."""
    pair = F.concat(F.lit('{"comment": '), json_string(_part("comment")), F.lit(', "next_question": '), json_string(_part("next_question_rephrased")), F.lit("}"))
    return _switch({t: pair if t == "response" else _part(s.quality_text) for t, s in TASKS.items()}, F.lit(None).cast("string"))


def _valid() -> Column:
    """Known task, required fields present, answer not blank."""
    required = {t: [c for _, c in s.prompt if c != "target_audience"] + list(s.texts) for t, s in TASKS.items()}
    ok = {}
    for t, columns in required.items():
        every = F.lit(True)
        for c in columns:
            every = every & F.col(c).isNotNull()
        ok[t] = every & ~T.is_blank(F.col(TASKS[t].quality_text))
    return F.coalesce(_switch(ok, F.lit(False)), F.lit(False))


def to_messages(records: DataFrame, system_prompts: dict[str, str], id_col: str = "ord") -> DataFrame:
    """(id, messages, carried columns) of valid records: system, user, assistant."""
    rows = with_clean_task(records).where(_valid())
    system = _switch({t: F.lit(system_prompts.get(t, "")) for t in TASKS}, F.lit(""))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("system", system), message("user", user_text()), message("assistant", assistant_text()))
    return rows.select(id_col, messages.alias("messages"), *("task_type" if c == "task_type" else _part(c).alias(c) for c in CARRIED))


def conversion_errors(records: DataFrame) -> DataFrame:
    """(task_type, converted, errors)."""
    ok = _valid()
    return with_clean_task(records).groupBy("task_type").agg(F.sum(ok.cast("long")).alias("converted"), F.sum((~ok).cast("long")).alias("errors"))


def without_assistant(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "assistant")


def rendered(messages: Column, before: str = "<|", after: str = "|>\n", end: str = "\n") -> Column:
    """One text from the messages, each after its role's marker."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(end))), "")


def request_messages(df: DataFrame, system_prompts: dict[str, str]) -> DataFrame:
    """System and user messages for generation; unknown tasks raise when evaluated."""
    known = F.when(F.col("task_type").isin(*TASKS), user_text()).otherwise(F.raise_error(F.concat(F.lit("unknown task "), _part("task_type"))).cast("string"))
    filled = with_clean_task(df).fillna({c: v for c, v in (("invalid_type", "too_short"), ("target_audience", "")) if c in df.columns})
    system = _switch({t: F.lit(system_prompts.get(t, "")) for t in TASKS}, F.lit(""))
    return filled.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), known.alias("content"))))
