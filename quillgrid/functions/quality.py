"""Kinds of answers, and what is wrong with questions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, col, has_lost_characters, is_low_information, let, search_tokens, squeeze

# Patterns of prompts, texts and answers.
GENERIC_PROMPTS = ("^关于[“\"]?.+[”\"]?，下列哪项", "^下列哪项关于[“\"]?.+[”\"]?", "^根据知识库内容，下列哪个")
FOCUSED_PROMPTS = (
    "^关于[“\"]?(.+?)[”\"]?，下列哪项表述正确[？?]?$",
    "^关于[“\"]?(.+?)[”\"]?，下列哪个时间或数值是正确的[？?]?$",
    "^关于[“\"]?(.+?)[”\"]?，下列哪一项术语或缩写是正确的[？?]?$",
    "^关于[“\"]?(.+?)[”\"]?，下列哪项命令或参数写法是正确的[？?]?$",
    "^“(.+?)”对应的内容是[？?]?$",
)
NOISY_FOCUS = "|".join(
    (
        r"^第\d+讲",
        r"^输出文档",
        r"^回顾",
        r"^拓展阅读",
        r"^实践练习",
        r"^思考题",
        r"^截图来自",
        r"^向下翻页$",
        r"^下一条",
        r"^其赋值格式为$",
        r"^数据格式$",
        r"^格式$",
        r"^规范",
        r"^目标$",
        r"^横坐标$",
        r"^纵坐标$",
        r"^第二列$",
        r"^第一列$",
        r"^[a-zA-Z]$",
    )
)
NOISY_MARKERS = "|".join(
    (
        "输出文档", "向下翻页", "截图来自", "拓展阅读", "实践练习", "思考题", "回顾",
    )
)
BAD_OPTIONS = ("#", "*", "-", "--", "不确定")
ATTRIBUTES = "属性|字段|标签|attribute|tag|参数"
YEAR_LIKE = "^\\d{2,4}(?:年|月|日)?$"
QUANTITY = "^\\d+(?:\\.\\d+)?\\s*(?:bp|kb|mb|gb|cm|cr|%|倍|次|个)?$"
COMMAND = "--|>|\\||/|\\.py|\\.sh|nohup|conda|datasets |dataformat "
ACRONYM = "^[A-Z][A-Za-z0-9\\-/+. ]{1,24}$"
SHORT_CJK = f"^[{CJK}]{{2,12}}$"
#: For the kind of a right answer, the other kinds that options may have.
COMPATIBLE = {"short_cjk": ("short_phrase", "acronym"), "short_phrase": ("short_cjk", "acronym"), "acronym": ("short_phrase", "short_cjk"), "sentence": ("short_phrase",)}


def answer_signature(x: Column | str) -> Column:
    return let(squeeze(x), kind_of)


def kind_of(value: Column) -> Column:
    """answer_signature of a squeezed text."""
    return (
        F.when(value.rlike(YEAR_LIKE) | F.lower(value).rlike(QUANTITY), "numeric")
        .when(value.rlike(COMMAND), "command")
        .when(value.rlike(ACRONYM), "acronym")
        .when(value.rlike(SHORT_CJK), "short_cjk")
        .when(F.length(value) <= 32, "short_phrase")
        .otherwise("sentence")
    )


def signatures_fit(right: Column, other: Column) -> Column:
    return reduce(lambda c, kv: c | ((right == kv[0]) & other.isin(*kv[1])), COMPATIBLE.items(), right == other)


def surface_bucket(x: Column | str) -> Column:
    return let(squeeze(x), bucket_of)


def bucket_of(value: Column) -> Column:
    """surface_bucket of a squeezed text."""
    return let(
        kind_of(value),
        lambda kind: F.when(kind.isin("numeric", "command", "sentence"), kind)
        .when(value.rlike(r"^[@A-Za-z][A-Za-z0-9_./+\-]{1,31}$"), "identifier")
        .when(value.rlike(f"^[{CJK}]{{2,10}}$"), "cjk-token")
        .otherwise("phrase"),
    )


def prompt_focus(x: Column | str) -> Column:
    """What a templated prompt asks about, '' if it follows no template."""
    text = squeeze(x)
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in FOCUSED_PROMPTS]
    return squeeze(F.coalesce(*found, F.lit("")))


def is_noisy_focus(x: Column | str) -> Column:
    focus = squeeze(x)
    return (focus == "") | focus.rlike(NOISY_FOCUS) | focus.rlike(NOISY_MARKERS) | (F.length(focus) <= 1)


def is_bad_option(x: Column | str) -> Column:
    return let(squeeze(x), bad_text)


def bad_text(text: Column) -> Column:
    """is_bad_option of a squeezed text."""
    return text.isin(*BAD_OPTIONS) | (F.length(text) <= 1) | has_lost_characters(text)


def asks_for_attribute(x: Column | str) -> Column:
    return F.lower(squeeze(x)).rlike(ATTRIBUTES)


def is_generic_prompt(x: Column | str) -> Column:
    text = squeeze(x)
    return (text == "") | text.rlike("|".join(f"(?:{p})" for p in GENERIC_PROMPTS))


def quality_issues(prompt: Column | str, analysis: Column | str, options: Column | str, answer: Column | str) -> Column:
    """Codes of what is wrong with a question; an empty array if nothing is."""
    given = F.coalesce(col(options), F.array().cast("array<struct<key:string,text:string>>"))
    picked = F.filter(given, lambda o: o["key"] == col(answer))
    right = squeeze(F.when(F.size(picked) > 0, F.element_at(picked, 1)["text"]))
    parts = F.struct(squeeze(prompt).alias("text"), squeeze(analysis).alias("note"), F.transform(given, lambda o: squeeze(o["text"])).alias("texts"), right.alias("right"))
    return let(parts, lambda p: let(_traits(p), lambda t: _issues(p, t)))


def _traits(p: Column) -> Column:
    kind = F.when(p["right"] == "", "short_phrase").otherwise(kind_of(p["right"]))
    kinds, buckets = F.transform(p["texts"], kind_of), F.transform(p["texts"], bucket_of)
    return F.struct(kind.alias("kind"), prompt_focus(p["text"]).alias("focus"), kinds.alias("kinds"), buckets.alias("buckets"))


def _issues(p: Column, t: Column) -> Column:
    text, note, texts, kind, focus, buckets = p["text"], p["note"], p["texts"], t["kind"], t["focus"], t["buckets"]
    noisy = (focus != "") & is_noisy_focus(focus)
    fitting = F.size(F.filter(t["kinds"], lambda k: signatures_fit(kind, k)))
    sizes = F.transform(F.array_distinct(buckets), lambda b: F.size(F.filter(buckets, lambda x: x == b)))
    odd = (F.size(sizes) >= 2) & (F.array_max(sizes) == F.size(texts) - 1) & (F.array_min(sizes) == 1)
    checks = (
        ("prompt-too-short", F.length(text) < 8),
        ("ocr-noise", has_lost_characters(text) | has_lost_characters(note)),
        ("noisy-focus", noisy),
        ("prompt-answer-mismatch-command", text.contains("命令或参数写法") & (kind != "command")),
        ("prompt-answer-mismatch-numeric", (text.contains("时间或数值") | text.contains("哪一年")) & (kind != "numeric")),
        ("prompt-answer-mismatch-acronym", text.contains("术语或缩写") & ~kind.isin("acronym", "short_phrase", "short_cjk")),
        ("mapping-fragment", text.contains("对应的内容是") & noisy),
        ("bad-option", F.exists(texts, bad_text)),
        ("option-signature-mismatch", (F.size(texts) > 0) & (fitting < F.greatest(F.lit(2), F.size(texts) - 1))),
        ("attribute-option-mismatch", (focus != "") & asks_for_attribute(focus) & (F.size(texts) >= 4) & odd),
        ("low-information-analysis", (note != "") & is_low_information(note)),
    )
    return F.array_compact(F.array(*[F.when(test, code) for code, test in checks]))


def is_usable_fact(title: Column | str, answer: Column | str) -> Column:
    """A short informative answer that does not just echo the title."""
    text = squeeze(answer)
    terms = F.struct(search_tokens(title).alias("title"), search_tokens(answer).alias("own"))

    def echoes(t: Column) -> Column:
        shared = F.size(F.array_intersect(t["title"], t["own"]))
        return (F.size(t["title"]) > 0) & (F.size(t["own"]) > 0) & (shared >= 0.8 * F.size(t["title"])) & (F.size(t["own"]) <= F.size(t["title"]) + 2)

    return (text != "") & (F.length(text) <= 96) & ~is_low_information(text) & ~let(terms, echoes)
