"""Evaluation texts inside a training corpus, by winnowing.

Method
------
Both sides keep, of every window of ``span - k + 1`` consecutive k-grams (k half the span) of
their cores, the one of least hash.  A shared run of ``span`` characters holds
one such window whole, so both sides keep the same k-gram of it and no run is
missed.  Hits are extended in both directions to the whole shared run, and a
document is reported for an item if a run reaches ``span`` characters.

The test side is small by nature: its cores and fingerprints are broadcast if
their size, which is measured, is at most ``broadcast_chars`` characters.  The
corpus is then read once and nothing of it is shuffled.  A larger test side is
joined by fingerprint instead (``broadcast_chars=0`` forces that way).

Defined results
---------------
* null or short texts, of either side, leak nothing
* equal items are each reported; a document is reported once for an item
* repeated document ids give repeated rows only if their texts differ in items
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .cores import core_string, cores, mix

#: Characters of the test side held by every worker; four bytes each and as much for fingerprints.
BROADCAST_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of x[i : i + width] for every i that has so many."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: -(width - have)], x[width - have :]) if have < width else x


class Winnowed:
    """Cores of some texts and the k-grams that winnowing keeps of them."""

    def __init__(self, texts: list[str], span: int):
        k = (span + 1) // 2
        window = span - k + 1
        self.points, self.owner = cores(texts)
        sizes = np.bincount(self.owner, minlength=len(texts)) if len(self.points) else np.zeros(len(texts), np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)
        n = len(self.points) - k + 1
        if n < window:
            return
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.points * _powers(_BASE, len(self.points) - 1), dtype=np.uint64)])
        h = mix((total[k:] - total[:-k]) * _powers(_INVERSE, n - 1))
        least = _sliding(h, window, np.minimum)
        least[self.owner[: len(least)] != self.owner[span - 1 :]] = 0  # a window that crosses texts
        # A gram is kept if it is the least of a window that holds it; of equal ones all are.
        edge = np.zeros(window - 1, np.uint64)
        self.places = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == h)
        self.hashes = h[self.places]

    def text(self, place: int) -> int:
        return int(self.owner[place])


def _run(a: Winnowed, p: int, b: Winnowed, q: int) -> int:
    """Length of the shared run of the cores around places p and q."""
    i, j = a.text(p), b.text(q)
    n = min(a.ends[i] - p, b.ends[j] - q)
    off = np.flatnonzero(a.points[p : p + n] != b.points[q : q + n])
    ahead = int(off[0]) if len(off) else int(n)
    n = min(p - a.starts[i], q - b.starts[j])
    off = np.flatnonzero(a.points[p - n : p] != b.points[q - n : q])
    return ahead + int(n) - (int(off[-1]) + 1 if len(off) else 0)


class Items:
    """The test side, sorted by fingerprint for look-ups."""

    def __init__(self, texts: list[str], span: int):
        self.kept = Winnowed(texts, span)
        order = np.argsort(self.kept.hashes, kind="stable")
        self.hashes, self.places, self.span = self.kept.hashes[order], self.kept.places[order], span

    def leaks(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, item) of each text that shares a run of ``span`` characters with an item."""
        docs = Winnowed(texts, self.span)
        lo = np.searchsorted(self.hashes, docs.hashes, side="left")
        hi = np.searchsorted(self.hashes, docs.hashes, side="right")
        found: set[tuple[int, int]] = set()
        for x in np.flatnonzero(hi > lo):
            p = int(docs.places[x])
            for q in self.places[lo[x] : hi[x]]:
                pair = (docs.text(p), self.kept.text(int(q)))
                if pair not in found and _run(docs, p, self.kept, int(q)) >= self.span:
                    found.add(pair)
        return sorted(found)


def leaked_documents(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, span: int = 80, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that share ``span`` characters of their core with an item."""
    left = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    right = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("u")).filter(F.col("u").isNotNull())
    kinds = f"d {left.schema['d'].dataType.simpleString()}, i {right.schema['i'].dataType.simpleString()}"
    size = right.agg(F.coalesce(F.sum(F.length("u")), F.lit(0))).first()[0]
    found = _by_broadcast(left, right, span, kinds) if size <= broadcast_chars else _by_join(left, right, span)
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def _by_broadcast(left: DataFrame, right: DataFrame, span: int, kinds: str) -> DataFrame:
    rows = right.collect()  # at most broadcast_chars characters
    ids = [r["i"] for r in rows]
    test = left.sparkSession.sparkContext.broadcast(Items([r["u"] for r in rows], span))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = B.texts_of(batch["t"])
            for a, b in B.steps(texts):
                hits = test.value.leaks(texts[a:b])
                yield pd.DataFrame({"d": batch["d"].iloc[[a + t for t, _ in hits]].to_numpy(), "i": [ids[k] for _, k in hits]})

    return left.mapInPandas(scan, kinds).distinct()


def _by_join(left: DataFrame, right: DataFrame, span: int) -> DataFrame:
    def prints(name: str, text: str, frame: DataFrame) -> DataFrame:
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = B.texts_of(batch[text])
                for a, b in B.steps(texts):
                    kept = Winnowed(texts[a:b], span)
                    yield pd.DataFrame({name: batch[name].iloc[a + kept.owner[kept.places]].to_numpy(), "h": B.signed(kept.hashes)})

        return frame.mapInPandas(emit, f"{name} {frame.schema[name].dataType.simpleString()}, h long").distinct()

    @F.pandas_udf("boolean")
    def shares(t: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([bool(Items([y], span).leaks([x])) for x, y in zip(t, u, strict=True)])

    pairs = prints("d", "t", left).join(prints("i", "u", right), "h").select("d", "i").distinct()
    whole = pairs.join(left.dropDuplicates(), "d").join(right.dropDuplicates(), "i")
    return whole.filter(shares("t", "u")).select("d", "i").distinct()


def leaks_exact(text: str | None, item: str | None, span: int) -> bool:
    """The definition itself, for tests."""
    x, y = core_string(text), core_string(item)
    return any(y[k : k + span] in x for k in range(len(y) - span + 1))
