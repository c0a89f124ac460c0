"""Keyword-stuffed pages, link lists and pages of tags.

Method
------
Every text gives features: the share of its most used word, of repeated n-grams,
of repeated lines, of characters in links, of separators, and of function
words.  Its lines are stuffing if they are bare links, or have no function
words and mostly words that the text's lists repeat, or if most of a long
line's n-grams repeat within it.  A text is spam if stuffing is the greater
part of it, one of the shares passes its threshold, and function words are
missing.  The latter threshold is calibrated per language from all documents: a
fixed part of the median of that language.

Glossaries, question sheets, tables, commands, sequences and links in or after
sentences are not stuffing: their lines have function words, or their words
are not repeated.

Defined results: null and blank texts are not spam; the language is told from
the text itself, since the column may be missing or wrong; every row of
repeated ids or texts is judged; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .blocks import steps, texts_of
from .cores import code_points, windows

# Words and characters that sentences of a language cannot do without.
_FUNCTION_WORDS = frozenset(
    "the of and to in is that with for by from has have been be as not are was were at only so its this which cannot must once unlike than where when if what how or on it an a "
    "der die das und nicht mit dem den von wird werden ist nach zu auf ein eine le la les des et est un une que dans pour pas avec el los las y en con por se para il di che non".split()
)
_FUNCTION_CHARS = frozenset("的了在是被把由从与和对让随及或而但为于以这那其将会可不没有需已仍只都也就并因所如若经")
_LINK = re.compile(
    r"<a\b[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|(?:https?|ftp)://[^\s<>|，。；、)\]]+|\bwww\.[^\s<>|，。；、)\]]+|\b[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,})/[^\s<>|，。；、)\]]*", re.I | re.S
)
_TAG = re.compile(r"<[^<>\n]{1,80}>")
_COMMAND = re.compile(r"\s--?[a-z][\w-]*(?:[\s=]|$)|^\s*[$>]\s")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’-]*")
_HAN = re.compile(r"[㐀-鿿]+")
_FUNCTION_HAN = re.compile(f"[{''.join(sorted(_FUNCTION_CHARS))}]")
_MARKUP = re.compile(r"^[\s>*•●■◆·-]+|\*\*|__|\\$|\\")
_WORD = re.compile(r"[A-Za-zÀ-ɏΑ-ω][A-Za-zÀ-ɏΑ-ω0-9'’-]*|[㐀-鿿]+")
_SEPARATOR = re.compile(r"[;；,，、|/·•#＃]")
#: Of its median in a language, the share of function words below which a text is no prose.
FUNCTION_PART = 0.8
GREATER_PART = 0.5
TOP_WORD, GRAM_REPEATS, LINE_REPEATS, LINKS, SEPARATORS = 0.06, 0.4, 0.3, 0.3, 0.03
#: Function words a word of a sentence, at least.
SENTENCE = 1 / 12
#: A word of a list counts as repeated from here on; a line is stuffing if such words are so much of it.
REPEATED, MOSTLY = 3, 0.6
#: Length of n-grams, and of the lines that are judged by them alone.
GRAM, LONG_LINE = 5, 80
#: Repeats are counted within so many characters, so that a long line of prose is judged like a short one.
STRETCH = 600
#: Characters whose n-grams are counted together.
STEP = 500_000
FEATURES = "language string, function_share double, top_word double, gram_repeats double, line_repeats double, link_share double, separators double, stuffing double"


def _function_count(line: str) -> tuple[int, int, int]:
    """Function words, words and ideographs of a lower-cased line; each ideograph is a word."""
    words = _LATIN.findall(line)
    function = sum(map(_FUNCTION_WORDS.__contains__, words))
    if line.isascii():
        return function, len(words), 0
    han = sum(map(len, _HAN.findall(line)))
    return function + (len(_FUNCTION_HAN.findall(line)) if han else 0), len(words) + han, han


def _words(line: str) -> list[str]:
    """Words of a list, without running numbers; ideographs by pairs."""
    out = []
    for w in _WORD.findall(line.lower()):
        if "㐀" <= w[0] <= "鿿" and len(w) > 2:
            out.extend(w[k : k + 2] for k in range(len(w) - 1))
        else:
            out.append(w.rstrip("0123456789") or w)
    return out


def gram_repeats(lines: list[str]) -> np.ndarray:
    """For each line, the share of n-grams that are not the first of their kind within their stretch of it."""
    points = code_points("\n".join(lines))
    line = np.cumsum(points == 10)
    kept = points != 10
    points, line = points[kept], line[kept]
    sizes = np.bincount(line, minlength=len(lines))
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    parts = -(-sizes // STRETCH)
    stretch = np.repeat(np.cumsum(parts) - parts, sizes) + place // STRETCH
    grams, owner = windows(points, stretch, GRAM)
    key = (owner.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    count = int(parts.sum())
    every = np.bincount(owner, minlength=count)
    first = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=count)
    of = np.repeat(np.arange(len(lines)), parts)
    total, distinct = np.bincount(of, every, len(lines)), np.bincount(of, first, len(lines))
    return 1 - distinct / np.maximum(total, 1) - (total == 0)


def _read(text: str) -> tuple[str, list[tuple[str, str]]]:
    """A text without markup, and its lines, each as it is and without links, in lower case."""
    text = html.unescape(text.replace("<br>", "\n").replace("<br/>", "\n"))
    lines = (_MARKUP.sub("", y).strip() for y in text.split("\n"))
    return text, [(x, (_TAG.sub(" ", _LINK.sub(" ", x)) if "/" in x or "<" in x else x).lower()) for x in lines if x]


def all_features(texts: list[str]) -> list[tuple[str, float, float, float, float, float, float, float]]:
    read = [_read(t) for t in texts]
    long = [rest for _, lines in read for _, rest in lines if len(rest) >= LONG_LINE]
    repeats = iter(gram_repeats(long).tolist() if long else [])
    return [_features(text, [(x, rest, next(repeats) if len(rest) >= LONG_LINE else 0.0) for x, rest in lines]) for text, lines in read]


def features(text: str) -> tuple[str, float, float, float, float, float, float, float]:
    return all_features([text])[0]


def _features(text: str, lines: list[tuple[str, str, float]]) -> tuple[str, float, float, float, float, float, float, float]:
    total = len("".join(text.split()))
    if not total:
        return "latin", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    links = function = words = han = 0
    stuffing, listed, grams = 0.0, [], 0.0
    for line, rest, again in lines:
        size = len("".join(line.split()))
        own = len("".join(rest.split())) if len(rest) != len(line) else size
        links += size - own
        f, n, ideographs = _function_count(rest)
        function += f
        han += ideographs
        words += n + (len(_LATIN.findall(line)) if size > own else 0)
        grams += own * again
        if f and f >= n * SENTENCE:
            if again > 0.5:
                stuffing += size
        elif size > own and own * 4 <= size:
            stuffing += size
        else:
            stuffing += size - own
            if not _COMMAND.search(rest):
                listed.append((own, rest))
    each = [(own, _words(rest)) for own, rest in listed]
    counts = Counter(w for _, ws in each for w in ws)
    for own, ws in each:
        size = sum(map(len, ws))
        if size and sum(len(w) for w in ws if counts[w] >= REPEATED) >= size * MOSTLY:
            stuffing += own
    top = max((len(w) * c for w, c in counts.items() if c >= REPEATED), default=0) / total
    line_repeats = sum(len(k) * c for k, c in Counter(x for x, _, _ in lines).items() if c > 1) / max(1, sum(len(x) for x, _, _ in lines))
    separators = sum(len(_SEPARATOR.findall(rest)) for _, rest in listed) / total
    language = "zh" if han * 6 > total else "latin"
    return language, function / max(1, words), top, grams / total, line_repeats, min(1.0, links / total), separators, min(1.0, stuffing / total)


def page_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, FEATURES) of every text that is not blank."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for batch in batches:
            texts = texts_of(batch["t"])
            rows = [r for a, b in steps(texts, STEP) for r in all_features(texts[a:b])]
            yield pd.DataFrame(rows, columns=names).assign(k=batch["k"].to_numpy())[["k", *names]]

    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length(F.trim("t")) > 0)
    return own.mapInPandas(work, f"k {own.schema['k'].dataType.simpleString()}, {FEATURES}").withColumnRenamed("k", key)


def stuffed_pages(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """The ``key`` of each spam page."""
    pages = checkpoint(page_features(docs, key, text))  # calibrated and judged from one reading
    # One row for each of the languages told apart, so two at most.
    prose = (F.col("stuffing") <= GREATER_PART) & (F.col("function_share") > 0)
    usual = pages.filter(prose).groupBy("language").agg((F.percentile_approx("function_share", 0.5, 1000) * FUNCTION_PART).alias("least"))
    shares = (F.col("top_word") >= TOP_WORD) | (F.col("gram_repeats") >= GRAM_REPEATS) | (F.col("line_repeats") >= LINE_REPEATS) | (F.col("link_share") >= LINKS) | (F.col("separators") >= SEPARATORS)
    spam = (F.col("stuffing") > GREATER_PART) & shares
    # Judged after the calibration: the join must not drop a page for want of a language's row.
    missing = F.col("function_share") < F.coalesce("least", F.lit(1.0))
    # Sentences made of nothing but the repeated words have function words all the same.
    return pages.filter(spam).join(F.broadcast(usual), "language", "left").filter(missing | (F.col("gram_repeats") >= GRAM_REPEATS)).select(key)
