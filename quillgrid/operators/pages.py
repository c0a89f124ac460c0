"""Entries from the pages and slides of documents.

A page or slide is one row with the number of its place; a group is one
document, so windows and lists never span a collection.  What is made of a page
alone stays within its row; only the census of repeated lines, the module that
is carried forward and equal pages look at a whole document.

Defined results: a blank page gives no entry; an entry without facts gives way
to none, and its page is not remembered; equal pages are one entry, the first,
with all their numbers and the most images of any; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_line, compact, is_bullets, is_contact, is_footer, lines, slug, squeeze
from .extract import facts_of_lines, weighted_keywords
from .segment import carry_modules, fingerprint, merge_wrapped, pick_title, repeated_lines

#: Lines of a body that facts, keywords and the fingerprint are made of; fixed values.
FACT_LINES, KEYWORD_LINES, PRINT_LINES = 14, 8, 12
_FACTS = "array<struct<question:string,answer:string,explanation:string>>"


def _kept(text: str, repeated: Column) -> Column:
    """Cleaned lines of a page that are content."""
    made = F.transform(lines(text), lambda t: squeeze(clean_line(t)))
    return F.filter(made, lambda t: (t != "") & ~is_contact(t) & ~is_footer(t) & ~is_bullets(t) & ~F.array_contains(repeated, t))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with costly columns, each worked out once: a generator keeps them from being copied into what uses them."""
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made")
    return rows.select("*", packed).select(*[c for c in rows.columns if c not in made], "_made.*")


def _without(body: Column, title: Column) -> Column:
    return F.filter(body, lambda t: compact(t) != compact(title))


def entries_of_bodies(parts: DataFrame, doc: str, place: str, name: Column, mark: str, kind: str) -> DataFrame:
    """Entries of rows (doc, place, title, body, images), equal ones as one."""
    named = carry_modules(parts.withColumn("_name", name), doc, place, "title", F.regexp_replace("_name", "[_-]", " "))
    prints = _once(named, print=fingerprint("title", "body", PRINT_LINES))
    with_facts = prints.filter(F.exists(F.slice("body", 1, FACT_LINES), lambda t: F.length(clean_line(t)) >= 2))
    # The first page of equal ones stands for all; the others leave their numbers and images.
    first = F.min_by(F.struct(place, "_name", "title", "module", "body"), place).alias("first")
    unique = with_facts.groupBy(doc, "print").agg(first, F.sort_array(F.collect_list(place)).alias("pages"), F.max("images").alias("images"))
    made = unique.select(doc, "first.*", "pages", "images")
    number = F.lpad(F.col(place).cast("string"), 4, "0")
    made = made.withColumn("id", F.concat(slug("_name"), F.lit(f"-{mark}"), F.when(F.length(F.col(place).cast("string")) > 4, F.col(place).cast("string")).otherwise(number)))
    made = made.withColumn("entry", F.to_json(F.struct(F.col(doc), F.col(place))))
    words = weighted_keywords(made, "entry", [(F.col("title"), 3), (F.col("module"), 2), (F.array_join(F.slice("body", 1, KEYWORD_LINES), " "), 1)])
    keywords = words.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    each = facts_of_lines(made.select("entry", "title", F.posexplode(F.slice("body", 1, FACT_LINES)).alias("at", "raw")), "entry", "raw", F.col("title"), "at")
    listed = F.sort_array(F.collect_list(F.struct("at", F.struct("question", "answer", "explanation").alias("fact"))))
    facts = each.groupBy("entry").agg(F.transform(listed, lambda x: x["fact"]).alias("facts"))
    whole = made.join(keywords, "entry", "left").join(facts, "entry")
    signals = F.struct(F.coalesce("images", F.lit(0)).cast("int").alias("image_count"), F.lit(kind).alias("page_kind"))
    kept = [F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.col("facts").cast(_FACTS).alias("facts")]
    return whole.select(doc, place, "id", "module", "title", F.substring(F.element_at("body", 1), 1, 120).alias("summary"), *kept, "pages", signals.alias("visual_signals"))


def page_entries(pages: DataFrame, doc: str, page: str, raw: str, layout: str, images: str, name: str) -> DataFrame:
    """Entries of pages that have a raw and a layout text: titles come from the layout, bodies from the raw lines."""
    census = repeated_lines(pages, doc, page, raw).groupBy(doc).agg(F.collect_set("line").alias("_repeated"))
    known = pages.join(census, doc, "left").withColumn("_repeated", F.coalesce("_repeated", F.array().cast("array<string>")))
    made = _once(_once(known, _raw=_kept(raw, F.col("_repeated")), _layout=_kept(layout, F.col("_repeated"))), _raw=merge_wrapped("_raw"))
    titled = _once(made, title=pick_title(F.when(F.size("_layout") > 0, F.col("_layout")).otherwise(F.col("_raw")), F.concat(F.coalesce(name, F.lit("")), F.lit(" page "), F.col(page).cast("string"))))
    bodies = _once(titled, _raw=_without(F.col("_raw"), F.col("title")), _layout=_without(F.col("_layout"), F.col("title")))
    body = F.when(F.size("_raw") > 0, F.col("_raw")).when(F.size("_layout") > 0, F.col("_layout")).otherwise(F.array("title"))
    whole = bodies.withColumn("body", body)
    blank = (squeeze(F.coalesce(raw, F.lit(""))) == "") & (squeeze(F.coalesce(layout, F.lit(""))) == "")
    parts = whole.filter(~blank).select(doc, page, "title", "body", F.col(images).alias("images"), F.col(name).alias("_own"))
    return entries_of_bodies(parts, doc, page, F.coalesce("_own", F.lit("")), "p", "pdf_slide")


def slide_entries(slides: DataFrame, doc: str, slide: str, titles: str, body: str, notes: str, images: str, name: str) -> DataFrame:
    """Entries of slides: the title of the slide, else the best of its blocks; notes that the body lacks follow it."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_line), lambda t: t != "")
    made = _once(slides, _t=clean(titles), _b=clean(body), _n=clean(notes))
    fallback = F.concat(F.coalesce(name, F.lit("")), F.lit(" slide "), F.col(slide).cast("string"))
    title = F.when(F.size("_t") > 0, F.element_at("_t", 1)).otherwise(pick_title("_b", fallback))
    merged = merge_wrapped(F.concat("_b", F.filter("_n", lambda n: ~F.array_contains("_b", n))))
    whole = _once(made, title=title, body=merged).withColumn("body", F.when(F.size("body") > 0, F.col("body")).otherwise(F.array("title")))
    parts = whole.select(doc, slide, "title", "body", F.col(images).alias("images"), F.col(name).alias("_own"))
    return entries_of_bodies(parts, doc, slide, F.coalesce("_own", F.lit("")), "s", "pptx_slide")
