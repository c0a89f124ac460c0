"""Browsing, searching and sampling a bank."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, search_key
from .assemble import seeded

ALL = "all"


@dataclass(frozen=True)
class Filters:
    """What is asked for; ``all`` or '' asks for nothing."""

    source: str = ALL
    topic: str = ALL
    type: str = ALL
    module: str = ALL
    search: str = ""

    @classmethod
    def of(cls, query: dict[str, str]) -> Filters:
        return cls(**{k: v for k, v in query.items() if k in cls.__dataclass_fields__ and v})

    def query(self) -> dict[str, str]:
        """Only what differs from the default."""
        return {k: v for k, v in asdict(self).items() if v != self.__dataclass_fields__[k].default}

    def condition(self) -> Column:
        """Equalities first, which the scan can use; the search looks through all texts of a question."""
        out = F.lit(True)
        for name in ("source", "topic", "type"):
            if getattr(self, name) != ALL:
                out = out & (F.col(name) == getattr(self, name))
        if self.module != ALL:
            out = out & F.coalesce(F.array_contains("knowledge_refs", self.module), F.lit(False))
        if self.search:
            needle = "".join(self.search.lower().split())
            out = out & haystack().contains(needle)
        return out


def haystack() -> Column:
    texts = [F.coalesce(c, F.lit("")) for c in ("prompt", "answer", "analysis", "topic_name")]
    lists = [F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " "), F.array_join(F.transform(F.coalesce(F.col("options"), F.array().cast("array<struct<key:string,text:string>>")), lambda o: o["text"]), " ")]
    return search_key(F.concat_ws(" ", *texts, *lists))


def sample(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows without replacement, the same ones under a seed."""
    return rows.orderBy(seeded(seed, key), key).limit(count)


def facet_counts(rows: DataFrame, facet: str, unknown: str = "Unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(facet, F.lit(unknown)).alias(facet)).agg(F.count(F.lit(1)).alias("questions"))


def page_search(pages: DataFrame, page: str, text: str, needle: str) -> DataFrame:
    """(page, snippet) of pages that contain the needle, white space and letter case aside."""
    wanted = "".join(needle.lower().split())
    from ..functions.text import snippet

    return pages.filter(search_key(text).contains(wanted)).select(page, snippet(text, needle).alias("snippet"))


def highlighted(x: Column | str, needle: str, left: str = "<mark>", right: str = "</mark>") -> Column:
    """Every occurrence of the needle (as plain text) between marks."""
    import re

    return F.regexp_replace(col(x), "(?i)" + re.escape(needle), f"{left}$0{right}")
