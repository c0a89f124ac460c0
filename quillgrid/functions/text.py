"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as a character class that Java and RE2 read alike.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CJK = r"\x{4e00}-\x{9fff}"
# Fixed values.
BULLETS = "•●▪■◆★·-–—:：;；|"
BULLET_LINE = r"^[?？•·●▪■◆★\-–—]+$"
CONTACT = r"email:|@|wx:|qq:|电话|tel"
FOOTER = r"all rights reserved|copyright"
PAGE_NUMBER = r"(?:^|\s)(?:page|页码?)\s*\d+(?:\s*/\s*\d+)?(?:$|\s)"
STOPWORDS = (
    "一个", "一些", "一种", "不是", "主要", "以及", "以上", "以下", "内容", "包括", "包含", "可以", "这个", "这里", "相关", "通过", "进行", "用于", "需要", "说明", "作用", "研究", "方法", "问题",
    "分析", "数据", "课程", "课时", "example", "portal", "slide", "slides", "the", "and", "for", "with", "from", "that", "this", "into", "using",
)
ASCII_TERM = r"[A-Za-z][A-Za-z0-9\-/+.]{1,}"
CJK_RUN = rf"[{CJK}]{{2,}}"
CONTACT_MARKERS = r"email:|wx:|qq:|tel|phone|http://|https://|www\."
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
ORGANISATIONS = (
    "大学", "学院", "学校", "系", "实验室", "college", "school", "department", "faculty", "university", "institute",
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null as ''."""
    return F.btrim(F.regexp_replace(F.coalesce(col(x), F.lit("")), SPACE + "+", " "))


def compact(x: Column | str) -> Column:
    """Without any white space; null as ''."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), SPACE + "+", "")


def search_key(x: Column | str) -> Column:
    return F.lower(compact(x))


def slug(x: Column | str, mode: str = "ascii", empty: str = "entry") -> Column:
    """Lower-cased words joined by hyphens.

    ``ascii`` keeps ASCII letters, digits and ideographs; ``unicode`` also any
    word character; ``word`` ASCII word characters with the underscore.
    """
    kept = {"ascii": f"[^a-zA-Z0-9{CJK}]+", "unicode": rf"[^\p{{L}}\p{{N}}_{CJK}]+", "word": f"[^a-zA-Z0-9_{CJK}]+"}[mode]
    made = F.btrim(F.regexp_replace(F.lower(squeeze(x)), kept, "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(empty))


def clean_line(x: Column | str) -> Column:
    """Squeezed, then without bullets at the ends; blanks that this uncovers stay."""
    return F.btrim(squeeze(x), F.lit(BULLETS))


def is_contact(x: Column | str) -> Column:
    return F.lower(col(x)).rlike(CONTACT)


def is_footer(x: Column | str) -> Column:
    low = F.lower(col(x))
    reprint = col(x).contains("未经同意") & (col(x).contains("转载") | col(x).contains("发布"))
    return low.rlike(FOOTER) | reprint | low.rlike(PAGE_NUMBER)


def is_bullets(x: Column | str) -> Column:
    return col(x).rlike(BULLET_LINE)


def lines(x: Column | str) -> Column:
    return F.split(F.coalesce(col(x), F.lit("")), LINE_BREAK)


def clean_lines(x: Column | str) -> Column:
    return F.filter(F.transform(lines(x), clean_line), lambda t: t != "")


def ascii_terms(x: Column | str) -> Column:
    return F.regexp_extract_all(col(x), F.lit(f"({ASCII_TERM})"))


def cjk_runs(x: Column | str) -> Column:
    return F.regexp_extract_all(col(x), F.lit(f"({CJK_RUN})"))


def _pieces(run: Column) -> Column:
    """A run of two as it is; a longer one as its pairs, and whole up to ten."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    whole = F.when(F.length(run) <= 10, F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(run) <= 2, F.array(run)).otherwise(F.concat(pairs, whole))


def keyword_tokens(x: Column | str) -> Column:
    """Terms for keywords: ASCII terms with their case, then the pieces of ideograph runs; stop words left out."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    every = F.concat(ascii_terms(x), F.flatten(F.transform(cjk_runs(x), _pieces)))
    return F.filter(every, lambda t: ~F.array_contains(stop, F.lower(t)))


def search_tokens(x: Column | str) -> Column:
    """Distinct terms for retrieval, in order: lower-cased ASCII terms, then ideograph runs of 2 to 12."""
    return let(squeeze(x), lambda t: F.array_distinct(F.concat(F.transform(ascii_terms(t), F.lower), F.filter(cjk_runs(t), lambda r: F.length(r) <= 12))))


def plain_tokens(x: Column | str) -> Column:
    """Distinct lower-cased ASCII terms and ideograph runs of any length."""
    text = squeeze(x)
    return F.array_distinct(F.concat(F.transform(ascii_terms(text), F.lower), cjk_runs(text)))


def is_low_information(x: Column | str, bare_at: bool = False) -> Column:
    """Contacts, addresses, or nothing but names of organisations.  ``bare_at``: any @ is a contact, runs of any length count."""
    names = F.array(*[F.lit(w) for w in ORGANISATIONS])

    def poor(low: Column) -> Column:
        marks = low.rlike(CONTACT_MARKERS + "|@") if bare_at else low.rlike(CONTACT_MARKERS) | low.rlike(EMAIL)
        return marks | let(plain_tokens(low) if bare_at else search_tokens(low), lambda t: (F.size(t) > 0) & (F.size(F.array_except(t, names)) == 0))

    return let(F.lower(squeeze(x)), poor)


def has_lost_characters(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit("")).contains("�")


ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "middot": "·", "copy": "©", "reg": "®", "hellip": "…", "mdash": "—", "ndash": "–", "times": "×", "deg": "°", "amp": "&"}


def html_text(x: Column | str) -> Column:
    """Text of a page: no scripts or styles, entities decoded, then no tags; at most one blank line in a row."""
    text = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = reduce(lambda t, e: F.replace(t, F.lit(f"&{e[0]};"), F.lit(e[1])), ENTITIES.items(), text)
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\n{3,}", "\n\n")


def escape_html(x: Column | str) -> Column:
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, col(x))


def snippet(x: Column | str, needle: str, before: int = 10, after: int = 40, otherwise: int = 50) -> Column:
    """The surroundings of ``needle``, or the start of the text."""
    at = F.instr(F.lower(col(x)), needle.lower())
    first = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(col(x), first, at + after - first)).otherwise(F.substring(col(x), 1, otherwise))


def relative_path(x: Column | str, base: str = "") -> Column:
    """Paths as they are if absolute or with a scheme, else below ``base``."""
    return F.when(col(x).rlike("^(https?:|data:|/)"), col(x)).otherwise(F.concat(F.lit(base), F.regexp_replace(col(x), r"^\.?/", "")))


def parse_option(x: Column | str) -> Column:
    """``"B. text"`` as (key, text); without a letter the key is ''."""
    text = F.btrim(F.coalesce(col(x), F.lit("")))
    key = F.regexp_extract(text, r"^([A-Z])\.", 1)
    return F.struct(key.alias("key"), F.btrim(F.when(key != "", F.substring(text, F.lit(3), F.length(text))).otherwise(text)).alias("text"))
