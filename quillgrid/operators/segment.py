"""Order-sensitive operators on lines, sections and pages.

Every input row carries its ordinal; nothing depends on the order of files.
Groups are single documents, so a window never spans a collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line, clean_lines, col, compact, is_bullets, is_contact, is_footer, let, lines, slug, squeeze


def exploded_lines(docs: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """(doc, *keep, line_no, raw): every line of every text, from 0."""
    return docs.select(doc, *keep, F.posexplode(lines(text)).alias("line_no", "raw"))


def made_lines(docs: DataFrame, doc: str, text: str, make, *keep: str) -> DataFrame:
    """(doc, *keep, line_no, line): ``make`` of every line, without empty ones.

    Lines are made before they are exploded: a filter on an exploded column is
    not pushed into the expression that made it, so each line is made once.
    """
    made = docs.select(doc, *keep, F.posexplode(F.transform(lines(text), make)).alias("line_no", "line"))
    return made.filter("line <> ''")


def cleaned_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, line, contact, footer, bullets): cleaned lines that are not empty, and what they look like."""
    made = made_lines(docs, doc, text, clean_line)
    return made.select(doc, "line_no", "line", is_contact("line").alias("contact"), is_footer("line").alias("footer"), is_bullets("line").alias("bullets"))


def sections(docs: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """(doc, section, title, module, id, summary, body): text between headings; without a body no section.

    A document of headings alone becomes one section whose body is its headings.
    """
    twice = lambda t: let(clean_line(t), lambda c: F.struct(c.alias("line"), clean_line(c).alias("again")))
    rows = docs.select(doc, name, F.posexplode(F.transform(lines(text), twice)).alias("line_no", "both")).select(doc, name, "line_no", "both.*").filter("line <> ''")
    heading = F.col("line").startswith("#")
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(heading.cast("int")).over(order)).withColumn("heading", heading)
    body = F.sort_array(F.collect_list(F.when(~F.col("heading") & (F.col("again") != ""), F.struct("line_no", F.col("again").alias("line")))))
    titled = F.max(F.when(F.col("heading"), F.btrim(F.regexp_replace("line", "^[# ]+", ""))))
    made = rows.groupBy(doc, name, "section").agg(titled.alias("head"), F.transform(body, lambda x: x["line"]).alias("body")).filter(F.size("body") > 0)
    full = docs.select(F.col(doc), F.col(name), clean_lines(text).alias("body")).filter(F.size("body") > 0)
    bare = full.join(made.select(doc).distinct(), doc, "left_anti").select(doc, name, F.lit(0).cast("long").alias("section"), F.lit(None).cast("string").alias("head"), "body")
    title = F.coalesce(F.nullif("head", F.lit("")), F.coalesce(F.col(name), F.lit("")))
    every = made.unionByName(bare).withColumn("title", title)
    module = F.when(F.col("title").contains("►"), F.btrim(F.split_part("title", F.lit("►"), F.lit(1)))).otherwise("Imported Source")
    return every.select(doc, "section", "title", module.alias("module"), slug("title").alias("id"), F.substring(F.element_at("body", 1), 1, 120).alias("summary"), "body")


def repeated_lines(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.12, least: int = 4) -> DataFrame:
    """(doc, line, pages): lines on so many pages of a document that they are no content."""
    found = pages.select(doc, page, F.explode(F.array_distinct(F.filter(F.transform(lines(text), squeeze), lambda t: F.length(t) >= 8))).alias("line"))
    total = pages.filter(squeeze(text) != "").groupBy(doc).agg(F.count(F.lit(1)).alias("total"))
    counted = found.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    enough = F.greatest(F.lit(least), F.floor(F.col("total") * share))
    many = counted.join(total, doc).filter(F.col("pages") >= enough)
    return many.filter(is_footer("line") | (F.length("line") > 16)).select(doc, "line", "pages")


def clean_pages(pages: DataFrame, doc: str, page: str, text: str, dropped: DataFrame) -> DataFrame:
    """(doc, page, line_no, line): a page's lines without repeated ones, contacts, footers and bare bullets.

    The census knows lines with their bullets, the look-up without: a repeated
    line with bullets at its ends stays.
    """
    made = made_lines(pages, page, text, lambda t: squeeze(clean_line(t)), doc)
    kept = made.filter(~is_contact("line") & ~is_footer("line") & ~is_bullets("line"))
    return kept.join(dropped.select(doc, "line"), [doc, "line"], "left_anti").select(doc, page, "line_no", "line")


def _joins(before: Column, now: Column) -> Column:
    a, b = F.btrim(before), F.btrim(now)
    return (
        a.rlike("[（(：:、/→-]$")
        | b.rlike("^[）)、，,；;]")
        | ((F.length(a) < 18) & (F.length(b) < 24) & ~a.rlike("[。！？!?]$"))
        | b.rlike("^[a-z0-9%/+-]")
    )


def merge_wrapped(x: Column | str) -> Column:
    """An array of lines with wrapped ones joined: a fold, since a joined line decides about the next."""
    given = F.filter(F.transform(col(x), clean_line), lambda t: t != "")

    def step(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(squeeze(F.concat(last, F.lit(" "), line))))
        return F.when(F.size(done) == 0, F.array(line)).when(_joins(last, line), joined).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(given, F.array().cast("array<string>"), step)


def title_score(line: Column, place: Column) -> Column:
    size = F.length(line)
    score = F.when((size >= 2) & (size <= 36), 4.0).when(size <= 60, 2.0).otherwise(-2.0)
    score += F.when(place == 0, 1.6).when(place == 1, 1.1).when(place <= 3, 0.5).otherwise(0.0)
    score += F.when(line.contains("第") & (line.contains("讲") | line.contains("章")), 3.2).otherwise(0.0)
    score += F.when(line.contains("►") | line.contains("内容概要"), 2.8).otherwise(0.0)
    score += F.when(line.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]"), 1.0).otherwise(0.0)
    score -= F.when(is_contact(line), 5.0).otherwise(0.0)
    return score - F.when(line.endswith("..."), 1.0).otherwise(0.0)


def pick_title(x: Column | str, fallback: Column) -> Column:
    """The best of the first six lines; of equal ones the first, equal lines count at their first place."""
    first = F.slice(col(x), 1, 6)
    place = lambda t: (F.array_position(first, t) - 1).cast("int")
    scored = F.transform(first, lambda t, i: F.struct(F.round(title_score(t, place(t)), 4).alias("score"), (-i).alias("rank"), t.alias("line")))
    return F.when(F.size(first) > 0, F.coalesce(F.nullif(F.array_max(scored)["line"], F.lit("")), fallback)).otherwise(fallback)


def own_module(title: Column | str) -> Column:
    """The module that a title names, null if it names none."""
    text = F.btrim(F.coalesce(col(title), F.lit("")))
    before = F.btrim(F.split_part(text, F.lit("►"), F.lit(1)))
    lecture = F.btrim(F.regexp_extract(text, r"第\d+讲(?:（\d+）)?\s*(\S.+)", 1))
    chapter = F.btrim(F.regexp_extract(text, r"第[一二三四五六七八九十0-9]+章\s*(\S.+)", 1))
    return F.nullif(F.when(text.contains("►"), before).when(lecture != "", lecture).otherwise(chapter), F.lit(""))


def carry_modules(pages: DataFrame, doc: str, page: str, title: str, stem: Column) -> DataFrame:
    """``pages`` with ``module``: the last one named up to each page, else the document's stem."""
    order = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("module", F.coalesce(F.last(own_module(title), ignorenulls=True).over(order), stem))


def fingerprint(title: Column | str, body: Column | str, size: int = 12) -> Column:
    parts = F.filter(F.transform(F.concat(F.array(col(title)), F.slice(col(body), 1, size)), compact), lambda t: t != "")
    return F.sha2(F.array_join(parts, "\u0001"), 256)


def unique_pages(pages: DataFrame, doc: str, page: str, title: str, body: str, images: Column) -> DataFrame:
    """(doc, page, title, pages, images): pages with equal fingerprints as the first, with all page numbers."""
    made = pages.select(doc, page, F.col(title).alias("title"), fingerprint(title, body).alias("print"), images.alias("images"))
    first = F.min_by("title", page).alias("title")
    grouped = made.groupBy(doc, "print").agg(F.min(page).alias(page), first, F.sort_array(F.collect_list(page)).alias("pages"), F.max("images").alias("images"))
    return grouped.drop("print")


def align_pages(texts: DataFrame, doc: str, page: str, text: str, counts: DataFrame, total: str) -> DataFrame:
    """(doc, page, text): the n-th page that is not blank has number n; up to the stated total, further pages are null."""
    own = texts.filter(squeeze(text) != "").select(doc, F.row_number().over(Window.partitionBy(doc).orderBy(page)).alias("page"), F.col(text).alias("text"))
    every = counts.filter(F.col(total) > 0).select(doc, F.explode(F.sequence(F.lit(1), F.col(total))).alias("page"))
    return every.join(own, [doc, "page"], "full_outer")


def slide_entry(title_blocks: Column, body_blocks: Column, notes: Column, fallback: Column) -> tuple[Column, Column]:
    """Title and merged body of a slide: its first title, else the best of its body; notes that the body lacks follow it."""
    titles = F.filter(F.transform(title_blocks, squeeze), lambda t: t != "")
    extra = F.filter(notes, lambda n: ~F.array_contains(body_blocks, n))
    body = merge_wrapped(F.concat(body_blocks, extra))
    title = F.when(F.size(titles) > 0, F.element_at(titles, 1)).otherwise(pick_title(body, fallback))
    return title, F.filter(body, lambda t: compact(t) != compact(title))


def context_lines(entries: DataFrame, group: str, order: str, own: Column, window: int = 1, most: int = 8) -> DataFrame:
    """``entries`` with ``context``: distinct lines of the neighbours up to ``window`` away, in order."""
    near = Window.partitionBy(group).orderBy(order).rowsBetween(-window, window)
    gathered = F.flatten(F.collect_list("own").over(near))
    return entries.withColumn("own", own).withColumn("context", F.slice(F.array_distinct(gathered), 1, most)).drop("own")


__all__ = [n for n in globals() if not n.startswith("_") and n != "annotations"]
