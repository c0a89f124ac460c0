"""Answers as a stream: the last of each question, kept in a table.

An addition to what batches do: records arrive late, twice and out of order, and
the table holds for each question what ``latest_answers`` would give over all
records so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import Folder

_ORDER = ("updated_at", "received_at", "record_id")


def last_records(records: DataFrame, key: str = "question_id") -> DataFrame:
    """The last record of each question, resets included: a reset must outlive the answers it takes back."""
    order = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), *_ORDER[1:])
    columns = [c for c in records.columns if c != key]
    return records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions, on whatever file system the folder is."""
    at = Folder(spark, folder)
    return sorted(int(n.removeprefix("v=")) for n in at.names() if n.startswith("v=") and at.exists(n, "_SUCCESS"))


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole version of the table."""
    done = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v={done[-1]}") if done else None


def keep_answers(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Merge every micro-batch into the table; each batch is a version, so one that is repeated changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        older = [v for v in _versions(spark, folder) if v < number]
        rows = last_records(batch)
        if older:
            rows = last_records(rows.unionByName(spark.read.parquet(f"{folder}/v={older[-1]}")))
        rows.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
