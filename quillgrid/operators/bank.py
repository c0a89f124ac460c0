"""Keeping a bank: upserts, roll-ups, serial numbers, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import top


def upsert(bank: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last value, at the first position (batch, order) that the key ever had.

    Aggregates keep one row a key and task before the shuffle, so a key of a
    third of all rows costs a row a task.
    """
    columns = [c for c in bank.columns if c in incoming.columns]
    rows = bank.select(F.lit(0).alias("_batch"), *columns).unionByName(incoming.select(F.lit(1).alias("_batch"), *columns))
    place = F.struct("_batch", order)
    made = rows.groupBy(key).agg(F.max_by(F.struct(*columns), place).alias("_row"), F.min(place).alias("_place"))
    return made.select("_row.*", F.col("_place._batch").alias("first_batch"), F.col(f"_place.{order}").alias("first_order"))


def roll_up(questions: DataFrame) -> DataFrame:
    """(facet, value, label, questions, with_image, with_note): counts by topic, type and source, and of all.

    One pass over the questions by grouping sets; labels are a topic's first name.
    """
    plain = questions.select(
        F.coalesce("topic", F.lit("unknown")).alias("topic"), F.coalesce("type", F.lit("single_choice")).alias("type"), F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.when(F.col("topic_name").isNotNull(), F.struct("row_id", "topic_name")).alias("named"), (F.coalesce("images.question", F.lit("")) != "").alias("image"), (F.coalesce("images.note", F.lit("")) != "").alias("note"),
    )
    sets = plain.groupingSets([["topic"], ["type"], ["source"], []], "topic", "type", "source").agg(
        F.grouping_id().alias("g"), F.min("named").alias("named"), F.count(F.lit(1)).alias("questions"), F.count_if("image").alias("with_image"), F.count_if("note").alias("with_note")
    )
    facet = F.when(F.col("g") == 3, "topic").when(F.col("g") == 5, "type").when(F.col("g") == 6, "source").otherwise("all")
    return sets.select(facet.alias("facet"), F.coalesce("topic", "type", "source", F.lit("")).alias("value"), F.when(F.col("g") == 3, F.col("named.topic_name")).alias("label"), "questions", "with_image", "with_note")


def last_serials(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, serial): the highest three-digit number at an id's end, 0 if there is none."""
    number = F.regexp_extract(F.coalesce(key, F.lit("")), r"-(\d{3})$", 1)
    return rows.groupBy(group).agg(F.coalesce(F.max(F.nullif(number, F.lit("")).cast("int")), F.lit(0)).alias("serial"))


def renumber(incoming: DataFrame, group: str, order: str, serials: DataFrame, prefix: Column) -> DataFrame:
    """``incoming`` with ``new_id``: running numbers of each group after those it has."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    made = incoming.withColumn("_n", place).join(serials, group, "left").withColumn("_n", F.col("_n") + F.coalesce("serial", F.lit(0)))
    digits = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return made.withColumn("new_id", F.concat(prefix, F.lit("-"), digits)).drop("_n", "serial")


def free_ids(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``incoming`` with ``free_id``: its id, or with -2, -3, ... after the bank's and earlier rows' uses of it."""
    used = existing.groupBy(key).agg(F.lit(1).alias("_used"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    made = incoming.withColumn("_n", place).join(used, key, "left").withColumn("_n", F.col("_n") + F.coalesce("_used", F.lit(0)))
    return made.withColumn("free_id", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), F.col("_n").cast("string")))).drop("_n", "_used")


def with_details(rows: DataFrame, details: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join on a key, missing details as given."""
    return rows.join(details, key, "left").fillna(defaults)


def entry_questions(entries: DataFrame, key: str, questions: DataFrame, question: str, refs: str) -> DataFrame:
    """(key, questions): how many questions refer to each entry; several equal references of a question count once."""
    named = questions.select(question, F.explode(F.array_distinct(refs)).alias("_ref")).groupBy("_ref").agg(F.count(F.lit(1)).alias("questions"))
    return entries.select(key).distinct().join(named, F.col(key) == F.col("_ref"), "left").select(key, F.coalesce("questions", F.lit(0)).alias("questions"))


def first_entries(questions: DataFrame, question: str, refs: str, entries: DataFrame, key: str) -> DataFrame:
    """(question, key): of each question, the first reference that an entry has."""
    named = questions.select(question, F.posexplode(refs).alias("_at", key)).join(entries.select(key).distinct(), key, "left_semi")
    return top(named, question, [F.col("_at")], 1).select(question, key)
