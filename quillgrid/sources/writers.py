"""Writers of knowledge bases, question batches, banks and figures.

``write_json`` leaves one document for people and portals, in parts as Spark
writes them; tables that other jobs read are better written as Parquet.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, folder: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    rows.write.mode("overwrite").json(folder)


def write_table(rows: DataFrame, folder: str, *by: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def write_document(rows: DataFrame, folder: str, field: str, meta: dict[str, str], order: str | None = None) -> None:
    """One JSON document ``{meta, field: [...]}``: for a batch or base of a size that one file holds.

    A collection of any size goes through ``write_table``.
    """
    item = F.struct(F.col(order).alias("_o") if order else F.monotonically_increasing_id().alias("_o"), F.struct(*rows.columns).alias("v"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"])
    head = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv])
    whole = rows.agg(listed.alias(field)).select(F.to_json(F.struct(head.alias("meta"), field), {"ignoreNullFields": "false"}).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(folder)


def write_export(questions: DataFrame, folder: str, title: str, now: datetime | None = None) -> None:
    """A batch with its title, time and count."""
    made = {"title": title, "exportedAt": (now or datetime.now(UTC)).isoformat(), "count": str(questions.count())}
    write_document(questions, folder, "questions", made)


def replace_table(rows: DataFrame, folder: str, spare: str) -> str:
    """``rows``, which may read ``folder``, as a new table in ``spare``; the caller then uses that path.

    A table cannot be overwritten while it is read: readers of the old path are not disturbed.
    """
    if folder.rstrip("/") == spare.rstrip("/"):
        raise ValueError("the new table needs another folder than the one it is read from")
    rows.write.mode("overwrite").parquet(spare)
    return spare


def clear(folder: str, like: DataFrame) -> None:
    """An empty table of the same columns."""
    like.limit(0).write.mode("overwrite").parquet(folder)
