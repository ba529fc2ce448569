"""What each task's records hold: one registry instead of branches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import text as T


@dataclass(frozen=True)
class TaskSpec:
    """Text columns of a task, near-duplicate rule (n words and Jaccard threshold, or an
    edit distance), prompt lines (label, column) and the system prompt's role."""

    texts: tuple[str, ...]
    quality_text: str
    prompt: tuple[tuple[str, str], ...]
    shingle: int | None = None
    jaccard: float | None = None
    edits: int | None = None


# Labels of the prompt lines.
TASKS: dict[str, TaskSpec] = {
    "response": TaskSpec(("comment", "next_question_rephrased"), "comment", (("주제: ", "topic"), ("현재 질문: ", "current_question"), ("사용자 응답: ", "user_answer"), ("다음 질문: ", "next_question_original")), 5, 0.7),
    "intro": TaskSpec(("message",), "message", (("주제: ", "topic"), ("타겟: ", "target_audience")), 5, 0.7),
    "first_question": TaskSpec(("message",), "message", (("주제: ", "topic"), ("첫 질문: ", "first_question_original")), 5, 0.7),
    "ending": TaskSpec(("message",), "message", (("주제: ", "topic"), ("타겟: ", "target_audience")), 5, 0.7),
    "retry": TaskSpec(("retry_message",), "retry_message", (("주제: ", "topic"), ("현재 질문: ", "current_question"), ("부적절 유형: ", "invalid_type")), 3, 0.75),
    "title": TaskSpec(("title",), "title", (("", "original_text"),), None, None, 2),
}


def _switch(of: dict[str, Column], other: Column) -> Column:
    out = None
    for task, c in of.items():
        out = F.when(F.col("task_type") == task, c) if out is None else out.when(F.col("task_type") == task, c)
    return out.otherwise(other)


def task_text() -> Column:
    """The text of a record that dedup compares; missing parts count as ''."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _switch({t: F.concat_ws("\n", *map(part, s.texts)) for t, s in TASKS.items()}, F.lit(""))


def quality_text() -> Column:
    """The text that quality metrics look at (for response the comment alone)."""
    return _switch({t: F.coalesce(F.col(s.quality_text), F.lit("")) for t, s in TASKS.items()}, F.lit(""))


def with_clean_task(df: DataFrame) -> DataFrame:
    return df.withColumn("task_type", T.clean_task(F.col("task_type")))
