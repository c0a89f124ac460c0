"""One form for texts that look alike.

Method
------
Every character has a quick-check property: stable (it never changes and never
joins what stands before it) or not.  A text is cut at stable characters; only
its unstable segments are normalised, together with the stable character before
them if a mark may join it, and the results are spliced back between the
untouched rest.  Most of a text is never looked at twice, and segments, of
which few differ, are remembered.

The form
--------
canonical composition, so accents stay; full-, half-width and small variants,
kinds of space, ligatures, radicals, and letters and signs of one shape become
the plain one; invisible characters go; spaces at the ends go.  Accents,
raised, lowered and enclosed digits, letter case, Greek letters unlike Latin
ones, and all wording stay apart.

Defined results: null stays null; a text of invisible characters becomes ''.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .cores import code_points

#: Not a character; it parts the texts of a batch.
_PART = chr(0x10FFFF)
# Letters and signs of one shape, as pairs of what they become and what becomes it.
_SAME_SHAPE = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν",
    "O": "ΟО", "P": "ΡР", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "οоօ", "p": "р",
    "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "μ": "µ", "Ω": "Ω",
    "-": "‐‑‒−⁃", ":": "∶꞉", "/": "⁄∕", "|": "∣ǀ", ",": "‚", ".": "․", "~": "∼", "·": "‧∙⋅・", "'": "ʼ", "*": "∗",
}
# Radicals without a decomposition, and the ideographs of the same shape.
_RADICALS = dict(
    zip("⺁⺎⺏⺐⺒⺓⺝⺟⺠⺴⺶⺸⻁⻄⻅⻆⻉⻋⻍⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳", "厂兀尣尢巳幺月母民罓羊羋虎西见角贝车辶长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙龟", strict=True)
)
#: Format characters that are seen.
_SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Not of a format category, but not seen either.
_UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Compatibility kinds that keep the shape.
_KEPT_KINDS = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<font>")
#: Further compatibility characters of the same shape: ligatures, Roman numerals, radicals.
_KEPT_RANGES = (range(0xFB00, 0xFB07), range(0x2160, 0x2180), range(0x2E80, 0x2FD6))
_RANGES = (range(0, 0x32400), range(0xE0000, 0xE0200))


def _folds() -> dict[str, str]:
    """What each character that changes on its own becomes, before composition."""
    folds = {c: to for to, many in _SAME_SHAPE.items() for c in many} | _RADICALS
    for points in _RANGES:
        for o in points:
            c, kind = chr(o), unicodedata.category(chr(o))
            if kind == "Zs" or c in "\t\n\v\f\r\x85  ":
                folds[c] = " "
            elif (kind in ("Cf", "Cc") and o not in _SEEN) or o in _UNSEEN:
                folds[c] = ""
            elif (parts := unicodedata.decomposition(c)) and c not in folds and (parts.startswith(_KEPT_KINDS) or parts[0] == "<" and any(o in r for r in _KEPT_RANGES)):
                folds[c] = "".join(folds.get(x, x) for x in unicodedata.normalize("NFKD", c))
    folds.pop(" ")
    return folds


def _class(chars: set[str]) -> str:
    """A regular-expression class of characters, as ranges."""
    points = sorted(map(ord, chars))
    out, k = [], 0
    while k < len(points):
        m = k
        while m + 1 < len(points) and points[m + 1] == points[m] + 1:
            m += 1
        out.append(f"\\U{points[k]:08x}-\\U{points[m]:08x}")
        k = m + 1
    return "".join(out)


class Canonical:
    """Quick-check classes and the normaliser of segments."""

    LIMIT = 1 << 16

    def __init__(self) -> None:
        self.folds = _folds()
        seconds, changing, marks = set(), set(), set()
        for points in _RANGES:
            for o in points:
                c = chr(o)
                parts = unicodedata.decomposition(c)
                if parts and parts[0] != "<" and " " in parts:
                    seconds.add(chr(int(parts.split()[1], 16)))
                if unicodedata.combining(c):
                    marks.add(c)
                if not unicodedata.is_normalized("NFC", c):
                    changing.add(c)
                elif parts and parts[0] != "<" and any(x in self.folds for x in unicodedata.normalize("NFD", c)):
                    changing.add(c)  # composed upon a letter that has a look-alike
        joining = marks | seconds | {chr(o) for o in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
        gone = {c for c, to in self.folds.items() if to == ""}
        unstable = joining | changing | set(self.folds)
        u, j = _class(unstable), _class(joining | gone)
        self.unstable = np.zeros(0x110000, bool)
        self.unstable[[ord(c) for c in unstable]] = True
        self.segment = re.compile(f"[^{u}]?[{j}][{u}]*|[{u}]+")
        self.known: dict[str, str] = {}

    def normal(self, segment: str) -> str:
        to = self.known.get(segment)
        if to is None:
            to = unicodedata.normalize("NFC", "".join(self.folds.get(c, c) for c in unicodedata.normalize("NFD", segment)))
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[segment] = to
        return to

    def of(self, text: str) -> str:
        if text.isascii() and text.isprintable():
            return text.strip(" ")
        return self.segment.sub(lambda m: self.normal(m[0]), text).strip(" ")

    def of_all(self, texts: list[str]) -> list[str]:
        """``of`` each text; the quick check runs over all of them at once, and only texts with an unstable segment are worked on."""
        points = code_points(_PART.join([t.replace(_PART, " ") if _PART in t else t for t in texts]))
        mixed = np.zeros(len(texts), bool)
        mixed[np.cumsum(points == 0x10FFFF, dtype=np.int64)[self.unstable[points]]] = True
        return [self.of(t) if m else t.strip(" ") for t, m in zip(texts, mixed.tolist(), strict=True)]


@lru_cache(maxsize=1)
def canonical() -> Canonical:
    return Canonical()


@F.pandas_udf(StringType())
def _form(texts: pd.Series) -> pd.Series:
    given = [None if t is None or t != t else t for t in texts.tolist()]
    forms = canonical().of_all(["" if t is None else t for t in given])
    return pd.Series([None if t is None else f for t, f in zip(given, forms, strict=True)], dtype=object)


def canonical_form(text: Column | str) -> Column:
    """The one form of a text column."""
    return _form(text)


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, two halves of the form's digest, the text's own), so that no text is shuffled."""
    form = df.select(key, text).filter(F.col(text).isNotNull()).withColumn("form", canonical_form(text)).filter(F.length("form") > 0)
    return form.select(key, F.xxhash64("form").alias("h1"), F.xxhash64("form", F.lit(1)).alias("h2"), F.xxhash64(text).alias("own"))


def look_alike_pairs(a: DataFrame, key_a: str, text_a: str, b: DataFrame, key_b: str, text_b: str) -> DataFrame:
    """(key_a, key_b) of texts of one form that are not the same string; blank forms match nothing."""
    left = _digests(a, key_a, text_a)
    right = _digests(b, key_b, text_b).withColumnRenamed("own", "other")
    return left.join(right, ["h1", "h2"]).filter(F.col("own") != F.col("other")).select(key_a, key_b)


__all__ = ["Canonical", "canonical", "canonical_form", "look_alike_pairs"]
