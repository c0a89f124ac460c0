"""Readers of knowledge sources, banks and answers.

Files are read by Spark (``binaryFile``, ``text``, ``json``); only archives are
opened in Python, by Arrow batches on the executors.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_text, lines, squeeze

SUFFIXES = (".json", ".md", ".txt", ".html", ".htm", ".docx", ".pdf", ".pptx")
IMAGES = (".png", ".jpg", ".jpeg")
_OPTION = "struct<key:string,text:string>"
FACT = "struct<question:string,answer:string,explanation:string,distractors:array<string>,keywords:array<string>,difficulty:int,type:string>"
ENTRY = f"id string, module string, title string, summary string, keywords array<string>, distractors array<string>, facts array<{FACT}>, sourcePages array<int>, sourceSlides array<int>, visualSignals struct<imageCount:int,pageKind:string>"
QUESTION = f"id string, source string, origin string, year int, topic string, topicName string, difficulty int, type string, prompt string, options array<{_OPTION}>, answer string, analysis string, knowledgeRefs array<string>, styleRefs array<string>, tags array<string>, images struct<question:string,note:string>, pdfPage int"
FIGURE = "id string, entryId string, page int, sourcePath string, sourceType string, module string, title string, summary string, summaryFocus string, contextLines array<string>, keywords array<string>, imageCount int, score double"


def suffix_of(path: str) -> str:
    return re.search(r"(\.[^./]*)?$", path)[0].lower()


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _listed(spark: SparkSession, path: str | list[str], field: str, element: str) -> DataFrame:
    """Elements of JSON files that are a list, or an object with the list under ``field``; with file and position."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    item = f"array<struct<{_typed(element)}>>"
    plain = F.from_json("value", item)
    nested = F.from_json("value", f"struct<{field}:{item}>")[field]
    is_list = F.col("value").rlike(r"^\s*\[")
    usable = F.when(is_list, plain).otherwise(nested)
    checked = raw.withColumn("items", F.when(usable.isNull(), F.raise_error(F.concat(F.lit(f"no list and no list named {field} in "), "file"))).otherwise(usable))
    return checked.select("file", F.posexplode("items").alias("position", "item")).select("file", "position", "item.*")


def _typed(ddl: str) -> str:
    schema = T.StructType.fromDDL(ddl)
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema)


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of knowledge bases in JSON."""
    return _listed(spark, path, "entries", ENTRY)


def read_bank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Questions of banks or generated batches in JSON."""
    return _listed(spark, path, "questions", QUESTION)


def read_figures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Figure candidates that a figure writer left."""
    return _listed(spark, path, "figures", FIGURE)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer, analysis, img_path, pdf_page) of a JSON map from ids to curated answers; page numbers that are none are null."""
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<answer:string,analysis:string,img_path:string,pdf_page:string>>"
    return raw.select(F.explode(F.from_json("value", kind)).alias("id", "v")).select("id", "v.answer", "v.analysis", "v.img_path", F.expr("try_cast(v.pdf_page AS INT)").alias("pdf_page"))


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, suffix, text) of plain text, Markdown and HTML files."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    kind = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    return raw.select("file", stem(F.col("file")).alias("name"), kind.alias("suffix"), F.when(kind.isin(".html", ".htm"), html_text("text")).otherwise(F.col("text")).alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a document, without empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    made = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(p for p in made if p)


def _block(element: ElementTree.Element) -> str:
    """All texts of an element as one block, parted by one space."""
    texts = ((t.text or "").strip() for t in element.iter(f"{_A}t"))
    return " ".join(" ".join(t for t in texts if t).split())


def pptx_slides(content: bytes) -> list[tuple[int, list[str], list[str], list[str], int]]:
    """(number, titles, body, notes, images) of each slide, in the order of their numbers."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k in numbers:
            root = ElementTree.fromstring(z.read(f"ppt/slides/slide{k}.xml"))
            titles, body = [], []
            for shape in root.iter(f"{_P}sp"):
                mark = shape.find(f".//{_P}ph")
                kind = mark.get("type") if mark is not None else None
                if block := _block(shape):
                    (titles if kind in ("title", "ctrTitle", "subTitle") else body).append(block)
            notes = []
            if (name := f"ppt/notesSlides/notesSlide{k}.xml") in names:
                notes = [t for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p") if (t := _block(p))]
            out.append((k, titles, body, notes, sum(1 for _ in root.iter(f"{_P}pic"))))
    return out


def _binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def read_docx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, suffix, text)."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "text": [docx_text(c) for c in batch["content"]]})

    made = _binary(spark, path).mapInPandas(opened, "file string, text string")
    return made.select("file", stem(F.col("file")).alias("name"), F.lit(".docx").alias("suffix"), "text")


def read_slides(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, slide, titles, body, notes, images)."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *s) for f, c in zip(batch["file"], batch["content"], strict=True) for s in pptx_slides(c)]
            yield pd.DataFrame(rows, columns=["file", "slide", "titles", "body", "notes", "images"])

    made = _binary(spark, path).mapInPandas(opened, "file string, slide int, titles array<string>, body array<string>, notes array<string>, images int")
    return made.withColumn("name", stem(F.col("file")))


def split_pages(texts: DataFrame, file: str, layout: str, raw: str) -> DataFrame:
    """(file, page, layout, raw) of texts whose pages end in form feeds; the longer of both gives the number of pages."""
    a, b = F.split(F.coalesce(layout, F.lit("")), "\f"), F.split(F.coalesce(raw, F.lit("")), "\f")
    both = texts.select(file, a.alias("a"), b.alias("b")).withColumn("n", F.greatest(F.size("a"), F.size("b")))
    page = both.select(file, "a", "b", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return page.select(file, "page", F.get("a", F.col("page") - 1).alias("layout"), F.get("b", F.col("page") - 1).alias("raw"))


def document_info(x: Column) -> Column:
    """A map of ``key: value`` lines, split at the first colon; the last of equal keys."""
    pairs = F.filter(F.transform(lines(x), lambda t: F.split(t, ":", 2)), lambda p: F.size(p) == 2)
    named = F.transform(pairs, lambda p: F.struct(F.btrim(p[0]).alias("k"), F.btrim(p[1]).alias("v")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def image_census(texts: DataFrame, file: str, listing: str) -> DataFrame:
    """(file, page, images) of a listing of images: rows of at least three fields that begin with a number, masks aside."""
    rows = texts.select(file, F.explode(lines(listing)).alias("row")).select(file, F.split(F.btrim("row"), r"\s+").alias("_fields"))
    kept = rows.filter((F.size("_fields") >= 3) & F.get("_fields", F.lit(0)).rlike(r"^\d+$") & (F.get("_fields", F.lit(2)) != "smask"))
    return kept.groupBy(file, F.get("_fields", F.lit(0)).cast("int").alias("page")).agg(F.count(F.lit(1)).cast("int").alias("images"))


def read_pdf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, layout, raw, info, listing) by the command-line tools for PDF, which every executor must have."""
    if shutil.which("pdftotext") is None:
        raise RuntimeError("pdftotext is not installed; give pages that were extracted before to split_pages")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(content: bytes, *command: str, needed: bool = True) -> str:
            got = subprocess.run(command, input=content, capture_output=True, check=False)
            if got.returncode and needed:
                raise RuntimeError(got.stderr.decode(errors="replace"))
            return "" if got.returncode else got.stdout.decode("utf-8", errors="replace")

        for batch in batches:
            rows = [(f, run(c, "pdftotext", "-layout", "-", "-"), run(c, "pdftotext", "-raw", "-", "-"), run(c, "pdfinfo", "-", needed=False), run(c, "pdfimages", "-list", "-", needed=False)) for f, c in zip(batch["file"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "layout", "raw", "info", "listing"])

    return _binary(spark, path).mapInPandas(opened, "file string, layout string, raw string, info string, listing string")


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, title, page_kind, image_count): stand-alone images as figure candidates; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return files.filter(F.lower("file").rlike(r"\.(png|jpe?g)$")).select("file", stem(F.col("file")).alias("title"), F.lit("standalone_image").alias("page_kind"), F.lit(1).alias("image_count"))


def legacy_items(script: str, name: str) -> list[dict]:
    """Objects of an array literal ``name = [...]`` in a script: unquoted keys, any quotes, comments."""
    found = re.search(rf"\b{re.escape(name)}\s*=\s*\[", script)
    if not found:
        return []
    out, depth, text, k = [], 1, ["["], found.end()
    while k < len(script) and depth:
        c = script[k]
        if c in "\"'`":
            end = k + 1
            while end < len(script) and script[end] != c:
                end += 2 if script[end] == "\\" else 1
            body = re.sub(r"\\(['`])", r"\1", script[k + 1 : end]).replace("\n", "\\n")
            text.append('"' + (body if c == '"' else re.sub(r'(?<!\\)"', r"\"", body)) + '"')
            k = end + 1
            continue
        if script.startswith("//", k):
            k = script.find("\n", k) if "\n" in script[k:] else len(script)
            continue
        if script.startswith("/*", k):
            k = script.find("*/", k) + 2
            continue
        depth += (c in "[{") - (c in "]}")
        text.append(c)
        k += 1
    import json

    whole = re.sub(r'([{,]\s*)([A-Za-z_]\w*)\s*:', r'\1"\2":', "".join(text))
    out = json.loads(re.sub(r",(\s*[\]}])", r"\1", whole))
    return [x for x in out if isinstance(x, dict)]


def read_legacy(spark: SparkSession, path: str | list[str], arrays: dict[str, int]) -> DataFrame:
    """(id, q, opts, image, year, source) of script pages; ``arrays`` gives each array's year."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(str(x.get("id")), x.get("q"), [str(o) for o in x.get("opts") or []], x.get("imgSrc"), year, str(year)) for text in batch["value"] for name, year in arrays.items() for x in legacy_items(text, name)]
            yield pd.DataFrame(rows, columns=["id", "q", "opts", "image", "year", "source"])

    return spark.read.text(path, wholetext=True).mapInPandas(opened, "id string, q string, opts array<string>, image string, year int, source string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, suffix, text) of a file by its suffix; one that no reader knows is an error."""
    kind = suffix_of(path)
    if kind in (".md", ".txt", ".html", ".htm"):
        return read_texts(spark, path)
    if kind == ".docx":
        return read_docx(spark, path)
    if kind == ".pptx":
        whole = F.concat_ws("\n", F.array_join("titles", "\n"), F.array_join("body", "\n"), F.array_join("notes", "\n"))
        slides = read_slides(spark, path).select("file", "name", "slide", whole.alias("text"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slide", "text"))), lambda s: s["text"]), "\n\n")
        return slides.groupBy("file", "name").agg(joined.alias("text")).select("file", "name", F.lit(".pptx").alias("suffix"), "text")
    if kind == ".pdf":
        return read_pdf(spark, path).select("file", stem(F.col("file")).alias("name"), F.lit(".pdf").alias("suffix"), F.replace("raw", F.lit("\f"), F.lit("\n\n")).alias("text"))
    raise ValueError(f"no reader for {kind or 'a file without suffix'}: {path}")


def pages_of(read: DataFrame) -> DataFrame:
    """(file, page, raw, layout, images, name) of texts read from PDF (file, layout, raw, info, listing), up to the stated number of pages."""
    from ..operators.segment import align_pages

    split = split_pages(read, "file", "layout", "raw")
    stated = read.select("file", F.coalesce(document_info(F.col("info"))["Pages"].try_cast("int"), F.lit(0)).alias("stated"))
    found = split.groupBy("file").agg(F.count(F.when(squeeze("layout") != "", 1)).alias("a"), F.count(F.when(squeeze("raw") != "", 1)).alias("b"))
    total = found.join(stated, "file").select("file", F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.greatest("a", "b")).cast("int").alias("total"))
    raw, layout = (align_pages(split, "file", "page", c, total, "total").withColumnRenamed("text", c) for c in ("raw", "layout"))
    pages = raw.join(layout, ["file", "page"], "full_outer").join(total, "file").filter(F.col("page") <= F.col("total"))
    return pages.join(image_census(read, "file", "listing"), ["file", "page"], "left").withColumn("name", stem(F.col("file"))).drop("total")


def build_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Entries of any source: those of a JSON base as they are, of pages and slides one each, sections of anything else."""
    from ..operators.extract import knowledge_base
    from ..operators.pages import page_entries, slide_entries
    from ..operators.segment import sections

    if suffix_of(path) == ".json":
        return read_entries(spark, path)
    if suffix_of(path) == ".pptx":
        return slide_entries(read_slides(spark, path), "file", "slide", "titles", "body", "notes", "images", "name")
    if suffix_of(path) == ".pdf":
        return page_entries(pages_of(read_pdf(spark, path)), "file", "page", "raw", "layout", "images", "name")
    docs = read_documents(spark, path)
    return knowledge_base(sections(docs, "file", "text", "name"), "file")


__all__ = [n for n in globals() if not n.startswith("_") and n != "annotations"]
