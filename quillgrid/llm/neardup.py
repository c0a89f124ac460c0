"""Near-duplicate records by a token-group matrix.

Method
------
Texts are partitioned into groups of similar texts: a text's home is the least
class it shares a block of minwise values with (``blocks``), over all its
blocks, and a home of many texts is cut into groups of about ``GROUP`` (by the
size of the block through which a text came to it).  Every
group stores the union of its members' tokens: as bit masks of their sketches,
and as the windows of their whole texts.  A text is a query to every other
group it shares a block with.  The masks bound its agreement with any member,
then the union of windows bounds its overlap: a member of likeness t shares t
of the query's windows at least, so a group whose union holds fewer is never
opened.  The groups that qualify are opened, and the query is held against the
windows of each member, which is the exact likeness.

Exact copies have one core and are one class (a 64-bit hash; copies are joined
on 128 bits): a class takes part once and its members are joined back at the
end.  A class of a third of all rows costs its batch one entry a table after
packing.  A block of many texts meets its groups in a join of small rows that
AQE splits; queries to one group go in blocks of ``QUERIES``.  No text is
shuffled for a pair: a member goes to its group, a query to each group whose
masks admit it.

Defined results
---------------
* null text counts as ''; a row whose core is shorter than ``n`` has no links
* rows with equal cores are linked (if they have a window), likeness 1
* repeated ids are kept as given: a pair of equal ids is not reported
* an empty table gives no links; other columns are neither read nor returned
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint, shuffle_partitions
from . import blocks as B
from .cores import core_string, distinct_windows

TABLES = 28
ENTRIES_A_SHARD = 1_500_000
#: Members of a group, about; queries to one group in one block, about.
GROUP, QUERIES = 32, 4096
#: Texts of a block that one task may pair with its groups.
HOT = 4096
#: Windows of pairs that are compared at once.
STEP_TOKENS = 4_000_000


def least_agreement(threshold: float, bits: int = B.SKETCH_BITS) -> int:
    """Sketch bits agree with probability (1 + t) / 2; four deviations below that."""
    p = (1 + threshold) / 2
    return int(bits * p - 4 * np.sqrt(bits * p * (1 - p)))


def _entries(docs: DataFrame, n: int, tables: int, shards: int) -> DataFrame:
    """Packed (block, class) by shard of the block, and in shards of their own packed (class, sketch), which no table repeats."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = B.Fingerprints(n, tables)
        for batch in batches:
            texts = B.texts_of(batch["text"])
            for a, b in B.steps(texts):
                own, keys, sketch = prints.of(texts[a:b])
                core = B.core_hashes(texts[a:b])[0][own]
                order = np.argsort(core, kind="stable")  # copies within the step are one entry
                order = order[np.r_[True, core[order][1:] != core[order][:-1]]] if len(order) else order
                core, keys, sketch = core[order], keys[order], sketch[order]
                yield B.sharded(keys.ravel(), shards, [keys.ravel(), np.repeat(core, tables)])
                own_shards = B.sharded(core, shards, [core, *sketch.T])
                own_shards["shard"] += shards
                yield own_shards

    return docs.select("text").mapInPandas(emit, B.ENTRY_SCHEMA)


def _runs(entries: DataFrame, shards: int) -> DataFrame:
    """(key, size, core, leader) of the blocks that several classes share, the leader being the least of these, and (core, s0, s1) of all."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs = []
        for batch in batches:
            for shard, blob in zip(batch["shard"], batch["entries"], strict=True):
                if shard < shards:
                    blobs.append(blob)
                else:
                    core, s0, s1 = B.unpack([blob], 3)
                    yield pd.DataFrame({"key": None, "size": None, "core": B.signed(core), "leader": None, "s0": B.signed(s0), "s1": B.signed(s1)})
        keys, core = B.unpack(blobs, 2)
        order = np.lexsort((core, keys))
        keys, core = keys[order], core[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (core[1:] != core[:-1])] if len(keys) else np.empty(0, bool)
        keys, core = keys[new], core[new]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        columns = {"key": keys, "size": np.repeat(sizes, sizes).astype(np.uint64), "core": core, "leader": np.repeat(core[starts], sizes)}
        several = np.repeat(sizes > 1, sizes)
        for a in range(0, len(keys), B.CHUNK):
            part = slice(a, a + B.CHUNK)
            yield pd.DataFrame({k: B.signed(v[part][several[part]]) for k, v in columns.items()} | {"s0": None, "s1": None})

    return entries.repartition(shards, F.col("shard") % shards).mapInPandas(keep, "key long, size long, core long, leader long, s0 long, s1 long")


def _agree(x: str, y: str) -> Column:
    """Equal bits of two sketches."""
    return sum((F.bit_count(F.bitwise_not(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}")))) for k in range(B.SKETCH_WORDS)), F.lit(0))


def _grouped(runs: DataFrame) -> DataFrame:
    """(key, size, core, s0, s1, gid, head): the blocks of all classes that share one, with their groups; one row of each class is its head."""
    of_class = Window.partitionBy("core")
    home = F.min(F.when(F.col("key").isNotNull(), F.struct("leader", F.ceil(F.col("size") / GROUP).alias("parts")))).over(of_class)
    own = [home.alias("home"), F.min("key").over(of_class).alias("least"), *[F.max(s).over(of_class).alias(s) for s in ("s0", "s1")]]
    cells = runs.select("key", "size", "core", *own).filter(F.col("key").isNotNull())
    gid = F.xxhash64("home.leader", "home.parts", F.pmod(F.xxhash64("core"), F.col("home.parts")))
    return cells.select("key", "size", "core", "s0", "s1", gid.alias("gid"), (F.col("key") == F.col("least")).alias("head"))


def _met(cells: DataFrame, least: int) -> DataFrame:
    """(core, s0, s1, gid): the queries to groups of other texts that the masks of sketches admit, from the lesser group to the greater."""
    unions = [f(s).alias(f"{name}{s}") for s in ("s0", "s1") for name, f in (("one_", F.bit_or), ("zero_", lambda s: F.bit_or(F.bitwise_not(F.col(s)))))]
    # The masks read a column of the join that they do not need, so that both read one shuffle and none is made for the masks alone.
    masks = cells.groupBy("key", F.col("gid").alias("to")).agg(F.max("core").alias("some"), *unions)
    held = [F.bit_count(F.col(s).bitwiseAND(F.col(f"one_{s}")).bitwiseOR(F.bitwise_not(F.col(s)).bitwiseAND(F.col(f"zero_{s}")))) for s in ("s0", "s1")]
    met = cells.join(masks, "key").filter((F.col("gid") < F.col("to")) & F.col("some").isNotNull() & (held[0] + held[1] >= least))
    return met.select("core", "s0", "s1", F.col("to").alias("gid"))


def _asked(cells: DataFrame, least: int) -> DataFrame:
    """All queries, each once.

    Blocks of few texts are shuffled once, for the masks and the join; those of
    more than HOT texts twice, so that their join can be split among tasks.
    """
    # Told beforehand that nothing is null, the optimizer adds no filter to one side only.
    columns = ["key", "size", "core", "s0", "s1", "gid"]
    kept = cells.select(*columns).filter(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    few = kept.filter(F.col("size") <= HOT).repartition(shuffle_partitions(cells.sparkSession), "key")
    return _met(few, least).unionByName(_met(kept.filter(F.col("size") > HOT), least)).distinct()


def _paired(groups: DataFrame, least: int) -> DataFrame:
    """(gid): the groups two members of which may be alike."""
    one = groups.select("gid", *[F.col(c).alias(f"x_{c}") for c in ("core", "s0", "s1")])
    two = groups.select("gid", *[F.col(c).alias(f"y_{c}") for c in ("core", "s0", "s1")])
    return one.join(two, "gid").filter((F.col("x_core") < F.col("y_core")) & (_agree("x_", "y_") >= least)).select("gid").distinct()


def classes_of(docs: DataFrame, key: str, n: int, wanted: DataFrame, count: int) -> DataFrame:
    """(key, core, digest, body) of rows with a window: two hashes of the core, and the core itself if the first may be in ``wanted``.

    ``wanted``: a column ``core``, ``count`` of them or fewer.
    """
    bitmap = B.collect_bitmap(wanted.select(F.col("core").alias("number")), B.bitmap_bits(count))

    def hash_cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = B.texts_of(batch["text"])
            for a, b in B.steps(texts):
                core, length, digest = B.core_digests(texts[a:b])
                own = np.flatnonzero(length >= n)
                hit = B.in_bitmap(bitmap.value, core)
                names = batch[key].iloc[a + own]
                bodies = pd.Series([core_string(texts[a + k]) if hit[k] else None for k in own], dtype=object, index=names.index)
                yield pd.DataFrame({key: names, "core": B.signed(core)[own], "digest": B.signed(digest)[own], "body": bodies})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInPandas(hash_cores, f"{key} {kind}, core long, digest long, body string")


def _positions(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each of ``sizes``, end to end."""
    return np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _shared(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Windows that texts i and j share, pair by pair."""
    out = np.zeros(len(i), np.int64)
    ends = np.cumsum(sizes[i] + sizes[j])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP_TOKENS, side="right")))
        text = np.concatenate([i[a:b], j[a:b]])
        at = np.repeat(starts[text], sizes[text]) + _positions(sizes[text])
        pair = np.repeat(np.r_[np.arange(b - a), np.arange(b - a)].astype(np.uint64), sizes[text])
        key = (pair << np.uint64(44)) | tokens[at]
        key.sort()
        out[a:b] = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64), minlength=b - a)
        a = b
    return out


def open_groups(group: np.ndarray, member: np.ndarray, home: np.ndarray, sketch: np.ndarray, texts: list[str], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Rows i and j of like texts, their likeness, and counts of what was asked and opened.

    ``group``: the rows' groups, ascending from 0; ``member``: whether a row is
    a member or a query; ``home``: whether members are compared among themselves.
    """
    tokens, owner = distinct_windows(texts, n)
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    cell = (group[owner].astype(np.uint64) << np.uint64(44)) | tokens
    union = np.unique(cell[member[owner]])
    at = np.minimum(np.searchsorted(union, cell), max(0, len(union) - 1))
    held = union[at] == cell if len(union) else np.zeros(len(cell), bool)
    bound = np.bincount(owner[held], minlength=len(texts))
    opens = np.where(member, home, bound >= threshold * sizes - 1e-9)
    order = np.lexsort((~member, group))  # members first
    count = np.bincount(group[member], minlength=int(group.max(initial=-1)) + 1)
    all_of = np.bincount(group, minlength=len(count))
    first = np.cumsum(all_of) - all_of
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    asks = np.flatnonzero(opens & (count[group] > 0)) if len(count) else np.empty(0, np.int64)
    many = count[group[asks]]
    i = np.repeat(asks, many)
    j = order[np.repeat(first[group[asks]], many) + _positions(many)]
    once = ~member[i] | (place[j] > place[i])
    i, j = i[once], j[once]
    near = B.agreeing(sketch[i], sketch[j]) >= least_agreement(threshold)
    i, j = i[near], j[near]
    able = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[able], j[able]
    both = _shared(tokens, starts, sizes, i, j)
    like = both / np.maximum(1, sizes[i] + sizes[j] - both)
    good = like >= threshold
    figures = {"queries": int((~member).sum()), "opened": int((~member & opens).sum()), "compared": len(i), "found": int(good.sum())}
    return i[good], j[good], like[good], figures


def _matrix(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, likeness) from rows (gid, part, core, s0, s1, body, member), of which one (gid, part) lies in one partition, in order."""

    def links(held: pd.DataFrame) -> pd.DataFrame:
        group = np.r_[0, np.cumsum((held["gid"].to_numpy()[1:] != held["gid"].to_numpy()[:-1]) | (held["part"].to_numpy()[1:] != held["part"].to_numpy()[:-1]))]
        core = held["core"].to_numpy()
        i, j, like, _ = open_groups(group.astype(np.int64), held["member"].to_numpy(), held["part"].to_numpy() == 0, held[["s0", "s1"]].to_numpy().view(np.uint64), B.texts_of(held["body"]), n, threshold)
        x, y = core[i], core[j]
        differ = x != y
        return pd.DataFrame({"a": np.minimum(x, y)[differ], "b": np.maximum(x, y)[differ], "likeness": like[differ]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            chars += int(batch["body"].str.len().sum())
            if chars < B.STEP_CHARS:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            cut = len(whole) - int(((whole["gid"] == last["gid"]) & (whole["part"] == last["part"])).sum())
            if cut:  # the last group may go on in the next batch
                yield links(whole.iloc[:cut].reset_index(drop=True))
                whole = whole.iloc[cut:].reset_index(drop=True)
            held, chars = [whole], int(whole["body"].str.len().sum())
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(walk, "a long, b long, likeness double")


def class_links(docs: DataFrame, key: str, *, n: int, threshold: float, tables: int = TABLES) -> tuple[DataFrame, DataFrame]:
    """(core a, core b, likeness) of linked classes, and the classes' (key, core, digest) members."""
    spark = docs.sparkSession
    shards = max(shuffle_partitions(spark), docs.count() * tables // ENTRIES_A_SHARD)
    blocks = checkpoint(_grouped(_runs(_entries(docs, n, tables, shards), shards)))
    groups = blocks.filter("head").select("core", "s0", "s1", "gid")
    least = least_agreement(threshold)
    asked = checkpoint(_asked(blocks, least))
    # Groups take part that are asked, or that may hold a pair.
    parts = asked.groupBy("gid").agg(F.count("*").alias("asked")).unionByName(_paired(groups, least).withColumn("asked", F.lit(0).cast("long")))
    parts = parts.groupBy("gid").agg(F.greatest(F.lit(1), F.ceil(F.sum("asked") / QUERIES)).cast("int").alias("parts"))
    members = groups.join(parts, "gid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("member", F.lit(True)).drop("parts")
    queries = asked.join(parts, "gid").withColumn("part", F.pmod(F.xxhash64("core"), F.col("parts")).cast("int")).withColumn("member", F.lit(False)).drop("parts")
    cells = checkpoint(members.unionByName(queries))
    rows = checkpoint(classes_of(docs, key, n, cells.select("core"), cells.count()))
    bodies = rows.filter(F.col("body").isNotNull()).groupBy("core").agg(F.first("body").alias("body"))
    laid = cells.join(bodies, "core").repartition(shuffle_partitions(spark), "gid", "part").sortWithinPartitions("gid", "part")
    return _matrix(laid.select("gid", "part", "core", "s0", "s1", "body", "member"), n, threshold).distinct(), rows.select(key, "core", "digest")


def near_duplicate_pairs(df: DataFrame, key: str, text: Column, *, n: int = 4, threshold: float = 0.7) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of rows whose likeness by ``n`` reaches ``threshold``."""
    docs = df.select(F.col(key), F.coalesce(text, F.lit("")).alias("text")).filter(F.col(key).isNotNull())
    links, rows = class_links(docs, key, n=n, threshold=threshold)
    left = rows.select(F.col(key).alias("x"), F.col("core").alias("a"), F.col("digest").alias("d"))
    right = rows.select(F.col(key).alias("y"), F.col("core").alias("b"), F.col("digest").alias("e"))
    between = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right, (F.col("a") == F.col("b")) & (F.col("d") == F.col("e")) & (F.col("x") < F.col("y"))).select("x", "y")
    between = between.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return between.unionByName(within).filter(F.col("x") < F.col("y")).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))
