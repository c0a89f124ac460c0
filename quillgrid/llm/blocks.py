"""Bit fingerprints cut into blocks, tables of blocks, and the pairs that share one.

A text's fingerprint has ``tables`` blocks of 32 bits (four minwise values of
eight bits each) and a sketch of 128 bits, the lowest of each of its bytes (of
further minwise values where the blocks have fewer bytes).  Two texts
of likeness J agree in a block with probability about J**4, so one of 28 blocks
agrees with probability 0.9996 at J = 0.7 and 0.99995 at 0.75; each bit of the
sketch agrees with probability (1 + J) / 2.

Entries travel as packed columns, one row for each batch and shard, not as one
row for each entry: Spark moves a few large binary values, and sorting and
pairing are array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ..runtime import BROADCAST_LIMIT
from .cores import MinHasher, core_digests, core_hashes, cores, distinct_windows, mix

ROWS_A_BLOCK = 4
#: Words of 64 bits in a sketch.
SKETCH_WORDS = 2
SKETCH_BITS = 64 * SKETCH_WORDS
#: Texts in one step of fingerprinting; bounds a worker's memory whatever the batch.
STEP_CHARS = 4_000_000
#: Members of one group of the token-group matrix.
GROUP = 32
#: Pairs or bounds worked out at once.
CHUNK = 1 << 20
ENTRY_SCHEMA = "shard int, entries binary"


class Fingerprints:
    """Keys and sketches of a batch of texts, for windows of ``n`` characters."""

    def __init__(self, n: int, tables: int):
        self.n, self.tables = n, tables
        self.hasher = MinHasher(max(tables * ROWS_A_BLOCK, SKETCH_BITS))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts that have a window; a row of block keys and one of sketch words for each."""
        docs, values = self.hasher.matrix(*distinct_windows(texts, self.n))
        spread = values * np.uint32(0x9E3779B1)
        bits = (spread[:, :SKETCH_BITS] >> np.uint32(24)) & np.uint32(1)
        words = bits.reshape(len(docs), SKETCH_WORDS, 64).astype(np.uint64)
        sketch = (words << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        parts = (spread[:, : self.tables * ROWS_A_BLOCK] >> np.uint32(24)).astype(np.uint64)
        keys = np.repeat(np.arange(self.tables, dtype=np.uint64)[None, :] << np.uint64(32), len(docs), axis=0)
        for k in range(ROWS_A_BLOCK):
            keys |= parts[:, k::ROWS_A_BLOCK] << np.uint64(8 * k)
        return docs, keys, sketch


def steps(texts: list[str], size: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about ``size`` characters each, whole texts."""
    a, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= size:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: high bytes repeat and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(_planes(c) for c in columns)


def unpack(blobs: Iterable[bytes], columns: int) -> list[np.ndarray]:
    raw = [np.frombuffer(blob, np.uint8).reshape(columns, 8, -1) for blob in blobs]
    if not raw:
        return [np.empty(0, np.uint64) for _ in range(columns)]
    whole = np.concatenate(raw, axis=2)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in whole]


def sharded(keys: np.ndarray, shards: int, columns: list[np.ndarray]) -> pd.DataFrame:
    """Rows of ENTRY_SCHEMA: the entries of one step by shard, each sorted by key."""
    shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    shard, columns = shard[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, np.int64)
    rows = [(int(shard[a]), pack([c[a:b] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(rows, columns=["shard", "entries"])


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bits of sketches, row by row; a row is one word or several."""
    equal = np.bitwise_count(~(x ^ y)).astype(np.int64)
    return equal.sum(axis=1) if equal.ndim > 1 else equal


def pairs_of_runs(keys: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs with equal keys whose sketches agree in ``least`` bits or more.

    ``keys`` is sorted.  A run of equal keys is a set of similar texts, cut into
    groups of GROUP texts that are neighbours by sketch.  A token is a sketch
    position with its bit; a group stores the union of its members' tokens as
    two masks.  A text's tokens in the union bound its agreement with every
    member, so only groups that reach ``least`` are opened.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    for size in np.unique(sizes[(sizes > 1) & (sizes <= GROUP)]):
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, CHUNK // len(i))
        for k in range(0, len(at), step):
            a = (at[k : k + step, None] + i[None, :]).ravel()
            b = (at[k : k + step, None] + j[None, :]).ravel()
            good = agreeing(sketch[a], sketch[b]) >= least
            yield a[good], b[good]
    for at, size in zip(starts[sizes > GROUP], sizes[sizes > GROUP], strict=True):
        yield from _matrix(at + np.argsort(sketch[at : at + size], kind="stable"), sketch, least)


def _matrix(members: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """pairs_of_runs for one long run: bound every text against every group, open what qualifies."""
    own = sketch[members]
    cuts = np.arange(0, len(members), GROUP)
    ones, zeros = np.bitwise_or.reduceat(own, cuts), np.bitwise_or.reduceat(~own, cuts)
    step = max(1, CHUNK // max(GROUP, len(cuts)))
    for a in range(0, len(members), step):
        q = own[a : a + step, None]
        bound = np.bitwise_count((q & ones[None, :]) | (~q & zeros[None, :]))
        text, group = np.nonzero(bound >= least)
        later = (group + 1) * GROUP > text + a  # each pair once
        text, group = text[later] + a, group[later]
        for k in range(0, len(text), CHUNK // GROUP):
            i = np.repeat(text[k : k + CHUNK // GROUP], GROUP)
            j = (group[k : k + CHUNK // GROUP, None] * GROUP + np.arange(GROUP)[None, :]).ravel()
            inside = (j > i) & (j < len(members))
            i, j = i[inside], j[inside]
            good = agreeing(own[i], own[j]) >= least
            yield members[i[good]], members[j[good]]


def distinct_pairs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows that differ, of columns of equal length."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return tuple(c[new] for c in columns)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# Sets of numbers as bitmaps -------------------------------------------------


def bitmap_bits(count: int, each: int = 16) -> int:
    """Bits for ``count`` numbers: about ``each`` of them, never over BROADCAST_LIMIT."""
    return min(BROADCAST_LIMIT * 8, 1 << max(16, (each * max(1, count) - 1).bit_length()))


def bitmap_places(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (mix(numbers.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """May be true of others too, is never false of a number in the set."""
    place = bitmap_places(numbers, len(bitmap) * 8)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def collect_bitmap(numbers: DataFrame, bits: int, of: Callable[[pd.DataFrame], np.ndarray] = lambda batch: batch["number"].to_numpy(np.int64)) -> Broadcast:
    """The set of ``numbers`` (a column ``number``, or what ``of`` finds in a batch) as a bitmap, broadcast.

    Numbers go to the task of their chunk, which alone builds it: each chunk is
    shipped once, whatever the number of rows and tasks, and the driver gets
    bits / 8 bytes at most.
    """
    size = chunk_bytes(bits)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(bitmap_places(of(batch), bits))
            yield pd.DataFrame({"chunk": (at // (size * 8)).astype(np.int32), "at": (at % (size * 8)).astype(np.int32)})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, at = batch["chunk"].to_numpy(), batch["at"].to_numpy()
            for chunk in np.unique(chunks).tolist():
                whole = held.setdefault(chunk, np.zeros(size, np.uint8))
                mine = at[chunks == chunk]
                np.bitwise_or.at(whole, mine >> 3, np.uint8(1) << (mine & 7).astype(np.uint8))
        yield pd.DataFrame([(k, v.tobytes()) for k, v in held.items()], columns=["chunk", "bytes"])

    parts = min(bits // 8 // size, 64)
    rows = numbers.mapInPandas(place, "chunk int, at int").repartition(parts, "chunk").mapInPandas(build, "chunk int, bytes binary").collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows:
        bitmap[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bytes"], np.uint8)
    return numbers.sparkSession.sparkContext.broadcast(bitmap)


def chunk_bytes(bits: int) -> int:
    return min(bits // 8, 65_536)


class BitmapBuilder:
    """A partition's set of numbers, put out as chunks that are not empty."""

    def __init__(self, bits: int):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8)

    def add(self, numbers: np.ndarray) -> None:
        place = bitmap_places(numbers, self.bits)
        np.bitwise_or.at(self.bytes, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))

    def rows(self) -> pd.DataFrame:
        size = chunk_bytes(self.bits)
        parts = self.bytes.reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        return pd.DataFrame({"chunk": used.astype(np.int32), "bytes": [parts[k].tobytes() for k in used]})


def texts_of(column: pd.Series) -> list[str]:
    return ["" if t is None or t != t else t for t in column.tolist()]


__all__ = [n for n in globals() if not n.startswith("_")] + ["core_digests", "core_hashes", "cores"]
