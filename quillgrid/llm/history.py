"""New batches held against everything accepted before, by bit fingerprints.

Method
------
A prompt's fingerprint has 1,024 bits: 32 blocks of 32 (``blocks``; four
minwise values of eight bits each).  Table r of the store is the fingerprint
rotated by r blocks, so that block r leads and is looked up; an entry keeps that
block, the class of the prompt and a fixed sample of 64 bits of the fingerprint,
one of each of its first 64 bytes.  A new batch looks up the entries that have
one of its blocks exactly, verifies the Hamming distance of the samples and
then the whole texts, and is appended, so later batches meet it.  Bits are of
minwise values and differ with probability (1 - J) / 2, which follows likeness
more sharply than signs of random projections do (README).

History is fingerprinted once, when it is written.  A batch reads the stored
blocks, of which a bitmap of its own blocks (size bound BROADCAST_LIMIT; beyond
it more entries pass, none is lost) lets through what it hits, and the stored
rows, of which only those are passed on that a candidate or an id asks for.
Entries of one block meet in a join of small rows, which AQE splits where one
block is hot.  A batch counts as accepted when its mark is written, which is
the last step; what an interrupted run left is overwritten by the next.

Defined results
---------------
* a row is reported if an earlier row has the same id, without regard to case
  and to spaces at the ends, or a prompt of likeness ``threshold`` or more
* null or blank ids match nothing; a null prompt, or one shorter than the
  window, has likeness 0 to every other, copies included
* earlier: any history row, or a batch row with a smaller order value; equal
  order values are not earlier than each other
* empty history or batch: rows of the batch are held against what there is
* batches are worked on in ascending order of their numbers, rows without one
  last; a row is held against its own batch and those before it
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Folder, checkpoint, shared_folder
from . import blocks as B
from .cores import core_string
from .neardup import least_agreement
from .verify import with_likeness

TABLES = 32
#: Bits of a fingerprint that an entry keeps, and of a bitmap for each number.
SAMPLE, BITS_EACH = 64, 64
#: Order value of every history row: before any batch row.
ACCEPTED = -(1 << 62)
#: Entries that are stored as one value: a Parquet page holds a hundred values at least, so these must be small.
PACKED = 1 << 11
#: Small row groups and pages, so that neither writers nor readers hold much of the packed values at once.
WRITTEN = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4"}
#: Such values that are opened at once.
BLOBS = 256
_SPACES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_ROWS = "core long, digest long, id string, idh long, ord long, body string"
_ENTRIES = "entries binary"
_HITS = "key long, core long, sample long, ord long"


def _plain_rows(rows: DataFrame, n: int) -> DataFrame:
    """(core, digest, id, idh, ord, body) of rows (id, text, ord); body is null where a text has no window."""

    def hash_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = B.texts_of(part["text"])
            for a, b in B.steps(texts):
                core, length, digest = B.core_digests(texts[a:b])
                bodies = [core_string(t) if k >= n else None for t, k in zip(texts[a:b], length.tolist(), strict=True)]
                own = {"core": B.signed(core), "digest": B.signed(digest), "ord": part["ord"].to_numpy()[a:b], "body": pd.Series(bodies, dtype=object)}
                yield pd.DataFrame(own | {c: part[c].iloc[a:b].reset_index(drop=True) for c in ("id", "idh")})

    plain = F.regexp_replace(F.lower("id"), _SPACES, "")
    ids = rows.select(F.when(F.length(plain) > 0, plain).alias("id"), "text", "ord")
    return ids.select("id", F.xxhash64(F.coalesce("id", F.lit(""))).alias("idh"), "text", "ord").mapInPandas(hash_rows, _ROWS)


def _entries(rows: DataFrame, n: int, tables: int) -> DataFrame:
    """Packed (block, class, sample, order) of stored rows, copies of one step with one order value once."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = B.Fingerprints(n, tables)
        for part in parts:
            bodies, orders, classes = B.texts_of(part["body"]), part["ord"].to_numpy(np.int64), part["core"].to_numpy(np.int64)
            for a, b in B.steps(bodies):
                own, keys, words = prints.of(bodies[a:b])
                core, order = classes[a:b][own].view(np.uint64), orders[a:b][own]
                by = np.lexsort((order, core))
                new = np.r_[True, (core[by][1:] != core[by][:-1]) | (order[by][1:] != order[by][:-1])] if len(by) else np.empty(0, bool)
                by = by[new]
                columns = [keys[by].ravel(), *[np.repeat(x[by], tables) for x in (core, words[:, 0], order.view(np.uint64))]]
                sort = np.argsort(columns[0], kind="stable")
                columns = [c[sort] for c in columns]
                yield pd.DataFrame({"entries": [B.pack([c[k : k + PACKED] for c in columns]) for k in range(0, len(sort), PACKED)]})

    return rows.filter(F.col("body").isNotNull()).select("core", "ord", "body").mapInPandas(emit, _ENTRIES)


def _opened(entries: DataFrame, bitmap: object = None) -> DataFrame:
    """Rows (key, core, sample, ord) of packed entries; with ``bitmap``, of the blocks in it."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            blobs = part["entries"].tolist()
            for k in range(0, len(blobs), BLOBS):
                columns = B.unpack(blobs[k : k + BLOBS], 4)
                if bitmap is not None:
                    hit = np.flatnonzero(B.in_bitmap(bitmap.value, columns[0]))
                    columns = [c[hit] for c in columns]
                yield pd.DataFrame({name: B.signed(c) for name, c in zip(("key", "core", "sample", "ord"), columns, strict=True)})

    return entries.mapInPandas(unpack, _HITS)


def _keys(batch: pd.DataFrame) -> np.ndarray:
    """The blocks of packed entries."""
    return B.unpack(batch["entries"], 4)[0]


def _bitmap(numbers: DataFrame, count: int, **of: object) -> object:
    return B.collect_bitmap(numbers, B.bitmap_bits(count, BITS_EACH), **of)


class History:
    """The store of accepted rows in a folder that every machine shares."""

    def __init__(self, spark: SparkSession, folder: str, n: int = 3, tables: int = TABLES):
        self.spark, self.n, self.tables = spark, n, tables
        self.root = Folder(spark, folder)

    def accepted(self) -> list[str]:
        return sorted(self.root.names("accepted"))

    def _write(self, rows: DataFrame, batch: str) -> None:
        """Rows (id, text, ord) as a batch that is not accepted yet."""
        _plain_rows(rows, self.n).write.mode("overwrite").options(**WRITTEN).parquet(self.root.path("rows", batch))
        _entries(self._rows([batch]), self.n, self.tables).write.mode("overwrite").options(**WRITTEN).parquet(self.root.path("entries", batch))

    def _rows(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(*[self.root.path("rows", b) for b in batches])

    def _stored(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(_ENTRIES).parquet(*[self.root.path("entries", b) for b in batches])

    def append(self, rows: DataFrame) -> str:
        """Rows (id, text, ord), accepted; the name of their batch."""
        batch = f"{len(self.accepted()):08d}"
        self._write(rows, batch)
        self.root.mark("accepted", batch)
        return batch

    def check(self, rows: DataFrame, threshold: float) -> DataFrame:
        """Order values of the rows (id, text, ord) that are not new; the rows are accepted afterwards."""
        before = self.accepted()
        batch = f"{len(before):08d}"
        self._write(rows, batch)
        new, every = self._rows([batch]), [*before, batch]
        size = new.count()
        own = _opened(self._stored([batch]))
        keys = _bitmap(self._stored([batch]), size * self.tables, of=_keys)
        met = _opened(self._stored(every), keys).select("key", F.col("core").alias("other"), F.col("sample").alias("theirs"), F.col("ord").alias("since"))
        distance = F.bit_count(F.col("sample").bitwiseXOR(F.col("theirs")))
        close = (F.col("core") != F.col("other")) & (F.col("since") < F.col("ord")) & (distance <= SAMPLE - least_agreement(threshold, SAMPLE))
        found = checkpoint(own.join(met, "key").filter(close).groupBy("core", "other").agg(F.min("since").alias("since")))
        asked = found.select(F.col("other").alias("number")).unionByName(new.select(F.col("core").alias("number")))
        cores, ids = _bitmap(asked, found.count() + size), _bitmap(new.filter(F.col("id").isNotNull()).select(F.col("idh").alias("number")), size)

        def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                texts = part["body"].notna().to_numpy() & B.in_bitmap(cores.value, part["core"].to_numpy(np.int64))
                same = part["id"].notna().to_numpy() & B.in_bitmap(ids.value, part["idh"].to_numpy(np.int64))
                out = part[texts | same].copy()
                out.loc[~texts[texts | same], "body"] = None
                yield out

        held = checkpoint(self._rows(every).mapInPandas(pick, _ROWS))
        bodies = held.filter(F.col("body").isNotNull()).groupBy("core").agg(F.first("body").alias("body"))
        theirs = bodies.select(F.col("core").alias("other"), F.col("body").alias("body_b"))
        scored = with_likeness(found.join(bodies.withColumnRenamed("body", "body_a"), "core").join(theirs, "other"), "body_a", "body_b", self.n)
        since = scored.filter(F.col("likeness") >= threshold).groupBy("core").agg(F.min("since").alias("since"))
        like = new.filter(F.col("body").isNotNull()).join(since, "core").filter(F.col("since") < F.col("ord")).select("ord")
        copies = held.filter(F.col("body").isNotNull()).groupBy("core", "digest").agg(F.min("ord").alias("since"))
        copied = new.filter(F.col("body").isNotNull()).join(copies, ["core", "digest"]).filter(F.col("since") < F.col("ord")).select("ord")
        named = held.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("ord").alias("since"))
        same = new.join(named, "id").filter(F.col("since") < F.col("ord")).select("ord")
        out = checkpoint(like.unionByName(copied).unionByName(same).distinct())
        self.root.mark("accepted", batch)
        for sent in (keys, cores, ids):
            sent.destroy()
        return out


def _named(rows: DataFrame, key: str | None, id_column: str, text: str) -> DataFrame:
    order = F.lit(ACCEPTED).cast("long") if key is None else F.col(key).cast("long")
    return rows.select(F.col(id_column).alias("id"), F.col(text).alias("text"), order.alias("ord")).filter(F.col("ord").isNotNull())


def write_history(rows: DataFrame, folder: str, *, key: str, id_column: str, text: str, n: int = 3) -> None:
    """Accepted rows, appended to the store in ``folder`` as earlier than any batch."""
    History(rows.sparkSession, folder, n).append(_named(rows, None, id_column, text))


def check_batch(spark: SparkSession, folder: str, batch: DataFrame, *, key: str, id_column: str, text: str, n: int = 3, threshold: float = 0.7) -> DataFrame:
    """Keys of the batch's rows that are not new, against the store; the batch is appended to it afterwards."""
    return History(spark, folder, n).check(_named(batch, key, id_column, text), threshold).select(F.col("ord").alias(key))


def repeats(history: DataFrame, incoming: DataFrame, *, key: str, id_column: str, text: str, batch: str | None = None, n: int = 3, threshold: float = 0.7) -> DataFrame:
    """The ``key`` of each incoming row that is not new.  ``key`` orders the rows and is a BIGINT.

    The store is built once; ``batch`` names the column of batch numbers, which
    are worked on one after the other, each against all before it.
    """
    spark = incoming.sparkSession
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    names = {"key": key, "id_column": id_column, "text": text}
    try:
        write_history(history, folder, n=n, **names)
        numbers = [r[0] for r in incoming.select(batch).distinct().collect()] if batch else [None]
        found = []
        for number in sorted(numbers, key=lambda x: (x is None, x)):
            part = incoming.filter(F.col(batch).eqNullSafe(F.lit(number))) if batch else incoming
            found.append(check_batch(spark, folder, part, n=n, threshold=threshold, **names))
    finally:
        Folder(spark, folder).delete()
    if not found:
        return incoming.select(F.col(key).cast("long").alias(key)).limit(0)
    return reduce(DataFrame.unionByName, found)
