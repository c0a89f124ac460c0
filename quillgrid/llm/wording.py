"""The wording of texts: their scripts, their words, and the vocabulary of a collection.

A word is a run of letters; in scripts written without spaces (Han, kana, Thai
and the like) every pair of neighbouring letters counts as one.  Names and
codes are left out: runs with a capital after their first letter, and runs next
to a digit.  Batches are worked on as one array of code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .cores import code_points, mix

_PART = chr(0x10FFFF)
_TOP = 0x20000
#: A vocabulary word occurs in one of so many texts at least.
ONE_IN = 5_000
#: And there are no more vocabulary words than this, whatever the collection.
MOST_WORDS = 500_000
SCRIPTS = ("none", "latin", "han", "kana", "hangul", "cyrillic", "greek", "arabic", "hebrew", "thai", "devanagari", "other")
_NAMED = {"LATIN": 1, "CJK": 2, "HIRAGANA": 3, "KATAKANA": 3, "HANGUL": 4, "CYRILLIC": 5, "GREEK": 6, "ARABIC": 7, "HEBREW": 8, "THAI": 9, "DEVANAGARI": 10}
#: Scripts of which neighbouring letters count as words.
_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")
#: English words of every subject; fixed values.
FUNCTION_WORDS = frozenset(
    "a about after all also am an and any are as at be because been before being but by can cannot could did do does for from had has have he her here his how i if in into is it its just "
    "may me might more most must my no nor not of on once only or other our out over own she should so some such than that the their them then there these they this those to too under until "
    "up us very was we were what when where whether which while who whom why will with would you your".split()
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its script, whether it is written without spaces, is a capital, is a digit."""
    script, unspaced = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    capital, digit = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for o in range(_TOP):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            name = unicodedata.name(c, "OTHER").replace("FULLWIDTH ", "").replace("HALFWIDTH ", "")
            first = name.split()[0].split("-")[0]
            script[o] = _NAMED.get(first, 11)
            unspaced[o] = first in _UNSPACED
            capital[o] = kind == "Lu"
        elif kind[0] == "M":
            script[o] = 255  # goes with the letter before it
        digit[o] = kind[0] == "N"
    script[_TOP:0x40000], unspaced[_TOP:0x40000] = 2, True
    return script, unspaced, capital, digit


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = code_points(_PART.join([t.replace(_PART, " ") if _PART in t else t for t in texts]))
    return points, np.cumsum(points == 0x10FFFF, dtype=np.int32)


def script_counts(texts: list[str]) -> np.ndarray:
    """Letters of each script, a row a text."""
    points, owner = _laid_out(texts)
    kind = _tables()[0][points]
    letter = (kind > 0) & (kind < 255)
    flat = owner[letter].astype(np.int64) * len(SCRIPTS) + kind[letter]
    return np.bincount(flat, minlength=len(texts) * len(SCRIPTS)).reshape(len(texts), len(SCRIPTS))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, their texts, and whether each is a run of letters (not a pair)."""
    points, owner = _laid_out(texts)
    script, unspaced, capital, digit = _tables()
    kind = script[points]
    wide = unspaced[points]
    spaced = (kind > 0) & ~wide
    low = code_points(_PART.join([t.replace(_PART, " ") if _PART in t else t for t in texts]).lower())
    if len(low) != len(points):  # a letter whose lower case is longer
        low = np.array([ord(chr(p).lower()[0]) if p < 0xD800 or p > 0xDFFF else p for p in points.tolist()], np.uint32)
    pair = np.flatnonzero(wide[:-1] & wide[1:]) if len(points) > 1 else np.empty(0, np.int64)
    pairs = mix((low[pair].astype(np.uint64) << np.uint64(32)) ^ low[pair + 1].astype(np.uint64)) if len(pair) else np.empty(0, np.uint64)
    edge = np.diff(np.r_[False, spaced, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return pairs, owner[pair], np.zeros(len(pair), bool)
    number = np.r_[False, digit[points], False]
    inner = np.r_[0, np.cumsum(capital[points] & spaced)]
    named = (inner[ends] - inner[np.minimum(starts + 1, ends)] > 0) | number[starts] | number[ends + 1]
    at = np.flatnonzero(spaced)
    place = (at - np.repeat(starts, ends - starts)).astype(np.uint64)
    parts = mix((low[at].astype(np.uint64) << np.uint64(32)) ^ (place * np.uint64(0x9E3779B97F4A7C15)))
    sizes = ends - starts
    runs = mix(np.add.reduceat(parts, np.cumsum(sizes) - sizes) ^ sizes.astype(np.uint64))[~named]
    own = owner[starts][~named]
    return np.r_[pairs, runs], np.r_[owner[pair], own], np.r_[np.zeros(len(pair), bool), np.ones(len(runs), bool)]


@lru_cache(maxsize=1)
def _function_hashes() -> np.ndarray:
    return np.sort(words(sorted(FUNCTION_WORDS))[0])


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def subject_counts(texts: list[str], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words that carry a subject, those of them in the vocabulary, and runs of letters of any kind."""
    h, owner, run = words(texts)
    n = len(texts)
    carries = ~among(h, _function_hashes())
    inside = among(h, vocabulary)
    return np.bincount(owner[carries], minlength=n), np.bincount(owner[carries & inside], minlength=n), np.bincount(owner[run], minlength=n)


def vocabulary(texts: DataFrame, text: Column) -> Broadcast:
    """The words of a collection that occur in one of ``ONE_IN`` of its texts or more, as a sorted array of hashes.

    No more than ``MOST_WORDS`` reach the driver: that many words, each in at
    least a MOST_WORDS-th of all distinct (text, word) pairs, are all there can be.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one = ["" if t is None or t != t else t for t in batch["text"].tolist()]
            h, owner, _ = words(one)
            by = np.lexsort((h, owner))
            h, owner = h[by], owner[by]
            new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.empty(0, bool)
            word, times = np.unique(h[new], return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "times": times.astype(np.int64), "texts": np.int64(0)})
            yield pd.DataFrame({"word": np.zeros(1, np.int64), "times": np.zeros(1, np.int64), "texts": np.full(1, len(one), np.int64)})

    counted = texts.select(text.alias("text")).mapInPandas(count, "word long, times long, texts long").groupBy("word").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts"))
    counted = checkpoint(counted)
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("times"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
    kept = counted.filter(F.col("times") >= max(2, total["times"] / MOST_WORDS, total["texts"] / ONE_IN))
    found = np.sort(kept.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    return texts.sparkSession.sparkContext.broadcast(found)


__all__ = ["FUNCTION_WORDS", "SCRIPTS", "among", "script_counts", "subject_counts", "vocabulary", "words"]
