"""Mixing overlapping sources to target shares of the token count.

Method
------
Texts are counted in tokens of a public tokenizer (its file is a parameter) and
equal texts are one.  Each text has a membership pattern, the planned sources
that hold it; documents are aggregated by pattern.  A min-cost flow routes the
patterns' tokens to the sources' quotas: every further use of a pattern costs
more than the one before (convex), and a source takes a pattern at most its
``max_repeat`` times.  The flow first fills the quotas as far as they can be
filled, then keeps repetition least.  It has one node a pattern, whatever the
number of documents.

What a source takes of a pattern is a number of uses of all its documents and
a rest; the rest goes to documents in seeded hash order.  Their running sum is
taken over hash buckets first, and document by document only in the one bucket
where the rest ends; the document that crosses the end is taken if that comes
nearer.

Defined results
---------------
* null texts and texts without tokens are in no mixture; nor are documents
  whose source has no plan (unless an equal text is in a planned source)
* a null share is an equal part of what the other shares leave below 1; then
  all shares are scaled to sum to 1; negative shares count as 0
* a null ``max_repeat`` is no cap, one below 1 takes nothing
* repeated plan rows of a source count once (largest share, least cap)
* a source that cannot reach its quota is reported with what it reached
* no documents or no plan: empty results
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .blocks import texts_of

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How a text is split before the merges of the rank files (a fixed value of theirs).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Uses of a pattern that have a price of their own; after them one price holds for twice as many uses each time, up to MOST_USES.
PRICED_USES, MOST_USES = 8, 1 << 30
BUCKETS = 4096
_FREE = 1 << 62


@lru_cache(maxsize=2)
def _encoding(path: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(d, s, h1, h2, tokens): id, source, digest of the text and its number of tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield batch[["d", "s", "h1", "h2"]].assign(tokens=np.array([len(encode(t)) for t in texts_of(batch["t"])], np.int64))

    own = docs.select(F.col(key).alias("d"), F.col(source).alias("s"), F.col(text).alias("t")).filter(F.length("t") > 0)
    own = own.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64("t", F.lit(1))})
    return own.mapInPandas(count, f"d {own.schema['d'].dataType.simpleString()}, s string, h1 long, h2 long, tokens long").filter("tokens > 0")


def shares(plan: list[tuple[str, float | None, int | None]]) -> dict[str, tuple[float, int]]:
    """Each source's share, of a sum of 1, and its cap."""
    rows: dict[str, list] = {}
    for source, share, cap in plan:
        if source is None:
            continue
        share = None if share is None or share != share else max(0.0, share)
        cap = _FREE if cap is None or cap != cap else max(0, int(cap))
        old = rows.setdefault(source, [share, cap])
        old[0] = share if old[0] is None else old[0] if share is None else max(old[0], share)
        old[1] = min(old[1], cap)
    given = sum(r[0] for r in rows.values() if r[0] is not None)
    unset = sum(r[0] is None for r in rows.values())
    rest = max(0.0, 1 - given) / unset if unset else 0.0
    total = sum(rest if r[0] is None else r[0] for r in rows.values())
    return {k: ((rest if r[0] is None else r[0]) / total if total else 0.0, r[1]) for k, r in rows.items()}


class Flow:
    """Min-cost flow over whole numbers: shortest paths by potentials, all paths of one length at once."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        potential = [0] * len(self.edges)
        while True:
            far = self._distances(source, potential)
            if far[sink] is None:
                return
            most = max(x for x in far if x is not None)
            potential = [p + (most if x is None else x) for p, x in zip(potential, far, strict=True)]
            while self._level(source, sink, potential):
                at = [0] * len(self.edges)
                while self._push(source, sink, potential, at):
                    pass

    def _distances(self, source: int, potential: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.edges)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in self.edges[x]:
                y = self.to[e]
                if self.room[e] and (far[y] is None or d + self.cost[e] + potential[x] - potential[y] < far[y]):
                    far[y] = d + self.cost[e] + potential[x] - potential[y]
                    heapq.heappush(heap, (far[y], y))
        return far

    def _tight(self, e: int, x: int, potential: list[int]) -> bool:
        return self.room[e] > 0 and self.cost[e] + potential[x] - potential[self.to[e]] == 0

    def _level(self, source: int, sink: int, potential: list[int]) -> bool:
        self.depth = {source: 0}
        queue = [source]
        for x in queue:
            for e in self.edges[x]:
                if self.to[e] not in self.depth and self._tight(e, x, potential):
                    self.depth[self.to[e]] = self.depth[x] + 1
                    queue.append(self.to[e])
        return sink in self.depth

    def _push(self, source: int, sink: int, potential: list[int], at: list[int]) -> int:
        path, x = [], source
        while x != sink:
            own = self.edges[x]
            while at[x] < len(own):
                e = own[at[x]]
                if self.depth.get(self.to[e]) == self.depth[x] + 1 and self._tight(e, x, potential):
                    break
                at[x] += 1
            if at[x] < len(own):
                path.append(own[at[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                at[x] += 1
            else:
                return 0
        amount = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= amount
            self.room[e ^ 1] += amount
        return amount


def route(patterns: dict[tuple[str, ...], int], plan: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each source takes of each pattern."""
    names, sources = sorted(patterns), sorted(plan)
    flow = Flow(len(names) + len(sources) + 2)
    start, end = len(names) + len(sources), len(names) + len(sources) + 1
    place = {s: len(names) + k for k, s in enumerate(sources)}
    taken = {}
    for k, name in enumerate(names):
        size = patterns[name]
        for use in range(PRICED_USES):
            flow.add(start, k, size, use)
        use = PRICED_USES
        while use < MOST_USES:
            flow.add(start, k, size * use, use)
            use *= 2
        flow.add(start, k, _FREE, use)
        for s in name:
            taken[name, s] = flow.add(k, place[s], min(_FREE, size * plan[s][1]))
    for s in sources:
        flow.add(place[s], end, round(total * plan[s][0]))
    flow.run(start, end)
    return {k: flow.room[e ^ 1] for k, e in taken.items() if flow.room[e ^ 1]}


def _plan_of(plan: DataFrame, source: str, share: str, cap: str) -> dict[str, tuple[float, int]]:
    return shares([tuple(r) for r in plan.select(source, share, cap).collect()])  # one row a source


def mixture(docs: DataFrame, plan: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", share: str = "target_share", cap: str = "max_repeat", seed: int = 17, total: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc, source, uses, tokens) and the report on its sources."""
    spark = docs.sparkSession
    wanted = _plan_of(plan, source, share, cap)
    counted = token_counts(docs, key=key, source=source, text=text, tokenizer=tokenizer)
    planned = F.col("s").isin(list(wanted)) if wanted else F.lit(False)
    classes = counted.groupBy("h1", "h2").agg(F.min("d").alias("d"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set(F.when(planned, F.col("s")))).alias("pattern"))
    classes = checkpoint(classes.filter(F.size("pattern") > 0).select("d", "tokens", "pattern"))
    sums = {tuple(r["pattern"]): r["t"] for r in classes.groupBy("pattern").agg(F.sum("tokens").alias("t")).collect()}
    whole = sum(sums.values()) if total is None else total
    taken = route(sums, wanted, whole)
    kind = "pattern array<string>, s string, uses long, rest long"
    rows = [(list(p), s, n // sums[p], n % sums[p]) for (p, s), n in sorted(taken.items())]
    takes = spark.createDataFrame(rows, kind)
    # Patterns are few: one row for each, and source of it, of any number of documents.
    each = classes.join(F.broadcast(takes), "pattern")
    order = F.xxhash64(F.lit(seed), "s", "d")
    each = each.withColumns({"order": order, "bucket": F.pmod(order, F.lit(BUCKETS)).cast("int")})
    group = ["pattern", "s"]
    by_bucket = each.filter("rest > 0").groupBy(*group, "bucket").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(Window.partitionBy(*group).orderBy("bucket"))
    edges = by_bucket.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy(*group).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before")), "bucket").alias("edge"))
    each = each.join(F.broadcast(edges), group, "left")
    last = F.col("bucket") == F.col("edge.bucket")
    running = F.sum("tokens").over(Window.partitionBy(*group).orderBy("order", "d").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = each.filter(last).withColumn("more", (2 * (F.col("edge.before") + running) - F.col("tokens") <= 2 * F.col("rest")).cast("long"))
    away = each.filter(~F.coalesce(last, F.lit(False))).withColumn("more", ((F.col("rest") > 0) & (F.col("bucket") < F.col("edge.bucket"))).cast("long"))
    mixed = away.unionByName(at_edge).withColumn("uses", F.col("uses") + F.coalesce("more", F.lit(0))).filter("uses > 0")
    mixed = mixed.select(F.col("d").alias(key), F.col("s").alias(source), "uses", "tokens")
    reached = mixed.groupBy(source).agg(F.sum(F.col("uses") * F.col("tokens")).alias("reached"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("docs"))
    held: dict[str, int] = {}
    for p, n in sums.items():
        for s in p:
            held[s] = held.get(s, 0) + n
    targets = spark.createDataFrame([(s, x, round(whole * x), held.get(s, 0), None if c == _FREE else c) for s, (x, c) in sorted(wanted.items())], f"{source} string, target double, quota long, available long, cap long")
    report = targets.join(reached, source, "left").fillna(0, ["reached", "most_uses", "docs"])
    share_of = F.col("reached") / F.greatest(F.sum("reached").over(Window.partitionBy()), F.lit(1))
    return mixed, report.withColumn("actual", F.round(share_of, 6))
