"""Pieces of SQL that say what the column functions say."""

from __future__ import annotations

from ..functions import quality as Q
from ..functions import text as T


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def one_of(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {lit(T.SPACE + '+')}, ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {lit(T.SPACE + '+')}, '', 'g')"


def clean(x: str) -> str:
    return f"trim({squeeze(x)}, {lit(T.BULLETS)})"


def slug(x: str, kept: str = f"[^a-zA-Z0-9{T.CJK}]+") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({squeeze(x)}), {lit(kept)}, '-', 'g'), '-'), ''), 'entry')"


def lines(x: str) -> str:
    return f"string_split_regex(coalesce({x}, ''), {lit(T.LINE_BREAK)})"


def clean_lines(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda l: {clean('l')}), lambda l: l <> '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def contact(x: str) -> str:
    return has(f"lower({x})", T.CONTACT)


def footer(x: str) -> str:
    return f"({has(f'lower({x})', T.FOOTER)} OR (contains({x}, '未经同意') AND (contains({x}, '转载') OR contains({x}, '发布'))) OR {has(f'lower({x})', T.PAGE_NUMBER)})"


def bullets(x: str) -> str:
    return has(x, T.BULLET_LINE)


def ascii_terms(x: str) -> str:
    return f"regexp_extract_all({x}, {lit('(' + T.ASCII_TERM + ')')}, 1)"


def cjk_runs(x: str) -> str:
    return f"regexp_extract_all({x}, {lit('(' + T.CJK_RUN + ')')}, 1)"


def search_tokens(x: str) -> str:
    """Not distinct; list functions that work on sets do not mind."""
    s = squeeze(x)
    return f"list_concat(list_transform({ascii_terms(s)}, lambda t: lower(t)), list_filter({cjk_runs(s)}, lambda t: length(t) <= 12))"


def in_order(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def plain_tokens(x: str) -> str:
    s = squeeze(x)
    return f"list_distinct(list_concat(list_transform({ascii_terms(s)}, lambda t: lower(t)), {cjk_runs(s)}))"


def keyword_tokens(x: str) -> str:
    pieces = "CASE WHEN length(r) <= 2 THEN [r] WHEN length(r) <= 10 THEN list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), [r]) ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
    return f"list_filter(list_concat({ascii_terms(x)}, flatten(list_transform({cjk_runs(x)}, lambda r: {pieces}))), lambda t: lower(t) NOT IN {one_of(T.STOPWORDS)})"


def low_information(x: str) -> str:
    low, tokens = f"lower({squeeze(x)})", search_tokens(x)
    return f"({has(low, T.CONTACT_MARKERS)} OR {has(low, T.EMAIL)} OR (len({tokens}) > 0 AND len(list_filter({tokens}, lambda t: t NOT IN {one_of(T.ORGANISATIONS)})) = 0))"


def signature(x: str) -> str:
    v = squeeze(x)
    return f"(CASE WHEN {has(v, Q.YEAR_LIKE)} OR {has(f'lower({v})', Q.QUANTITY)} THEN 'numeric' WHEN {has(v, Q.COMMAND)} THEN 'command' WHEN {has(v, Q.ACRONYM)} THEN 'acronym' WHEN {has(v, Q.SHORT_CJK)} THEN 'short_cjk' WHEN length({v}) <= 32 THEN 'short_phrase' ELSE 'sentence' END)"


def fits(right: str, other: str) -> str:
    return "(" + " OR ".join([f"{right} = {other}", *(f"({right} = {lit(k)} AND {other} IN {one_of(v)})" for k, v in Q.COMPATIBLE.items())]) + ")"


def bucket(x: str) -> str:
    v, s = squeeze(x), signature(x)
    return f"(CASE WHEN {s} IN ('numeric', 'command', 'sentence') THEN {s} WHEN {has(v, '^[@A-Za-z][A-Za-z0-9_./+-]{1,31}$')} THEN 'identifier' WHEN {has(v, f'^[{T.CJK}]{{2,10}}$')} THEN 'cjk-token' ELSE 'phrase' END)"


def focus(x: str) -> str:
    s = squeeze(x)
    return squeeze("coalesce(" + ", ".join(f"nullif(regexp_extract({s}, {lit(p)}, 1), '')" for p in Q.FOCUSED_PROMPTS) + ", '')")


def noisy(x: str) -> str:
    f = squeeze(x)
    return f"({f} = '' OR {has(f, Q.NOISY_FOCUS)} OR {has(f, Q.NOISY_MARKERS)} OR length({f}) <= 1)"


def generic(x: str) -> str:
    s = squeeze(x)
    return f"({s} = '' OR " + " OR ".join(has(s, p) for p in Q.GENERIC_PROMPTS) + ")"


def bad_option(x: str) -> str:
    s = squeeze(x)
    return f"({s} IN {one_of(Q.BAD_OPTIONS)} OR length({s}) <= 1 OR contains({s}, '�'))"


def flag(x: str) -> str:
    return f"CAST({x} AS INTEGER)"
