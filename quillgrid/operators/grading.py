"""Answers to questions: the last of each, and whether it is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, search_key

CHOICES = ("single_choice", "multiple_choice")


def latest_answers(records: DataFrame, key: str = "question_id") -> DataFrame:
    """The last record of each question by its own time, then by arrival; a reset (null answer) leaves none.

    Records without a time come before all others.  Delivered twice counts once.
    """
    order = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), "received_at", "record_id")
    last = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("record_id", "answer", "checked", "correct", "updated_at"), order).alias("r"))
    return last.select(key, "r.*").filter(F.col("answer").isNotNull())


def is_right(kind: Column | str, given: Column | str, expected: Column | str) -> Column:
    """Choices: equal letters (several given ones in order).  Texts: one contains the other, and no expected text takes any."""
    a, e = search_key(given), search_key(expected)
    letters = F.array_join(F.array_sort(F.split(a, "")), "")
    choice = F.when(col(kind) == "multiple_choice", letters == e).otherwise(a == e)
    text = (e == "") | ((a != "") & (a.contains(e) | e.contains(a)))
    return F.when(F.coalesce(col(kind).isin(*CHOICES), F.lit(False)), choice).otherwise(text)


def status(checked: Column | str, right: Column | str) -> Column:
    return F.when(~F.coalesce(col(checked), F.lit(False)), "open").when(F.coalesce(col(right), F.lit(False)), "right").otherwise("wrong")


def grade(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, record_id, right): last answers against the bank's keys; unknown questions are left out."""
    keys = questions.groupBy("id").agg(F.max_by(F.struct("type", F.col("answer").alias("expected")), "row_id").alias("q")).select(F.col("id").alias("question_id"), "q.*")
    return answers.join(keys, "question_id").select("question_id", "record_id", is_right("type", "answer", "expected").alias("right"))
