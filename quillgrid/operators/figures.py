"""Figures of a knowledge base: which can be explained, and how well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import CJK, col, is_low_information, plain_tokens, squeeze

# Fixed values.
GENERIC_TITLES = ("内容概要", "绪论", "引言", "引 言", "小结", "总结", "overview", "contents")
EXPLAINS = "是|用于|说明|帮助|表示|反映"


def title_penalty(x: Column | str) -> Column:
    low = F.lower(squeeze(x))
    hits = reduce(lambda a, t: a + low.contains(t).cast("double") * 4, GENERIC_TITLES, F.lit(0.0))
    return hits + low.rlike("^[?？]").cast("double") * 1.5 + (F.length(low) <= 4).cast("double")


def noise_penalty(x: Column | str) -> Column:
    text = squeeze(x)
    words = F.filter(F.split(text, " "), lambda w: w.rlike(r"^[\x00-\x7f]+$"))
    few = (F.size(words) >= 4) & (F.size(F.array_distinct(words)) <= 0.6 * F.size(words))
    lower = (F.size(words) > 0) & (text == F.lower(text)) & ~text.rlike(f"[{CJK}]")
    symbols = F.length(F.regexp_replace(text, r"[^0-9=+\-*/×.%()\[\]]", ""))
    score = few.cast("double") * 7 + lower.cast("double") * 5 + (symbols >= 0.18 * F.length(text)).cast("double") * 6 + text.rlike("^[?？]").cast("double") * 2
    return F.when(text == "", 6.0).otherwise(score)


def candidate_score(images: Column, facts: Column, keywords: Column, context: Column, title: Column | str, summary: Column | str) -> Column:
    length = F.aggregate(F.transform(context, F.length), F.lit(0), lambda a, x: a + x)
    return images * 3.0 + facts * 1.2 + keywords * 0.5 + F.least(length, F.lit(220)) / 55.0 - title_penalty(title) - noise_penalty(title) - noise_penalty(summary)


def _generic(title: Column) -> Column:
    return reduce(lambda a, t: a | F.lower(title).contains(t), GENERIC_TITLES, F.lit(False))


def is_explainable(title: Column | str, summary: Column | str) -> Column:
    name, text = squeeze(title), squeeze(summary)
    poor = (noise_penalty(text) >= 10) & (F.size(plain_tokens(text)) < 4)
    return (name != "") & (noise_penalty(name) < 10) & ~poor & ~(_generic(name) & ((text == "") | (text == name)))


def is_display_ready(title: Column | str) -> Column:
    name = squeeze(title)
    short = (F.length(name) <= 6) & ~name.rlike("[►(（]")
    return (name != "") & ~_generic(name) & ~short & (noise_penalty(name) < 8)


def summary_focus(title: Column | str, summary: Column | str, answers: Column) -> Column:
    """The summary if it explains something, else the first short answer that does, else the title."""
    name = F.coalesce(F.nullif(squeeze(title), F.lit("")), F.lit("该图示"))
    text = F.coalesce(F.nullif(squeeze(summary), F.lit("")), name)
    noisy = (noise_penalty(text) >= 6) | ((F.size(plain_tokens(text)) >= 4) & ~text.rlike(EXPLAINS))
    fit = lambda a: (a != "") & (F.length(a) <= 60) & ~is_low_information(a, True) & (noise_penalty(a) < 6) & a.rlike(EXPLAINS)
    found = F.filter(F.transform(F.coalesce(answers, F.array().cast("array<string>")), squeeze), fit)
    instead = F.when(F.size(found) > 0, F.element_at(found, 1))
    # a noisy summary stays noisy even if an answer was found for it
    return F.when(noisy, name).when(text == name, F.coalesce(instead, name)).otherwise(text)


def meaning(title: Column | str, focus: Column) -> Column:
    name = F.coalesce(F.nullif(squeeze(title), F.lit("")), F.lit("该图示"))
    return F.when((focus != "") & (focus != name), F.concat(F.lit("该图主要用于解释“"), name, F.lit("”，重点涉及"), focus, F.lit("。"))).otherwise(F.concat(F.lit("该图主要用于帮助理解“"), name, F.lit("”这一知识主题。")))


def figure_similarity(module_a: Column, module_b: Column, words_a: Column, words_b: Column, focus_a: Column, focus_b: Column) -> Column:
    same = ((module_a != "") & (module_a == module_b)).cast("double") * 2
    return same + F.size(F.array_intersect(words_a, words_b)) + 0.5 * F.size(F.array_intersect(plain_tokens(focus_a), plain_tokens(focus_b)))


def image_figure(path: Column | str) -> Column:
    """A stand-alone image as one candidate."""
    name = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")
    return F.struct(name.alias("title"), F.lit("standalone_image").alias("page_kind"), F.lit(1).alias("image_count"))
