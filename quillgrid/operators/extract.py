"""Keywords and facts of lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line, keyword_tokens


def weighted_keywords(rows: DataFrame, key: str, segments: list[tuple[Column, int]], most: int = 8) -> DataFrame:
    """(key, place, keyword, score): terms by the weights of the segments they occur in.

    Of equal scores the term that comes first counts more.
    """
    def weighed(n: int, text: Column, weight: int) -> Column:
        return F.transform(keyword_tokens(text), lambda t, i: F.struct(t.alias("keyword"), F.lit(weight).alias("weight"), (F.lit(n * 1_000_000) + i).alias("at")))

    parts = [weighed(n, text, weight) for n, (text, weight) in enumerate(segments)]
    tokens = rows.select(key, F.explode(F.concat(*parts)).alias("t")).select(key, "t.*")
    scored = tokens.groupBy(key, "keyword").agg(F.sum("weight").alias("score"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first"))
    return scored.withColumn("place", rank).filter(F.col("place") <= most).select(key, "place", "keyword", "score")


def _ends(x: Column, marks: str) -> Column:
    return F.btrim(x, F.lit(marks))


# The units of quantities, and how facts are put.
QUANTITY = r"(\d{4}年|\d+(?:\.\d+)?\s*(?:bp|kb|Mb|Gb|cM|cR|%|倍|次|个))"
MAPPED = r"([A-Za-z0-9\x{4e00}-\x{9fff}（）()\-+/]+)[：:]\s*(.+)"
#: A part before a word can only begin where the line does; anchored, the search is linear.
DEFINED = r"^(.+?)(?:是|指的是|可定义为)(.+)"
CONTAINED = r"^(.+?)(?:包括|包含)(.+)"


_PARTS = (("name", MAPPED, 1, " "), ("value", MAPPED, 2, "。 "), ("thing", DEFINED, 1, "：:，, "), ("mean", DEFINED, 2, "。 ，,"), ("whole", CONTAINED, 1, "：:，, "), ("members", CONTAINED, 2, "。 ，,"))


def with_facts(rows: DataFrame, line: str, title: Column) -> DataFrame:
    """``rows`` with the fact of each cleaned line: question and answer.

    The first rule whose parts are of fit length holds, else the line stands
    under its title.  Every pattern is a column of its own, found once a line.
    """
    made = rows.withColumn("_s", F.btrim(clean_line(line), F.lit("。")))
    made = made.withColumns({f"_{n}": _ends(F.regexp_extract("_s", p, k), m) for n, p, k, m in _PARTS} | {"_number": F.btrim(F.regexp_extract("_s", QUANTITY, 1))})
    fits = lambda a, b: F.length(a).between(2, 40) & F.length(b).between(1, 80)
    rule = F.when(F.length("_value").between(1, 80), 1).when(fits("_thing", "_mean"), 2).when(fits("_whole", "_members"), 3).when(F.col("_number") != "", 4).otherwise(5)
    made = made.withColumn("_rule", rule)
    said = lambda left, x, right: F.concat(F.lit(left), x, F.lit(right))
    question = (
        F.when(F.col("_rule") == 1, said("“", F.col("_name"), "”对应的内容是？"))
        .when(F.col("_rule") == 2, said("关于“", F.col("_thing"), "”，下列哪项表述正确？"))
        .when(F.col("_rule") == 3, said("“", F.col("_whole"), "”包括下列哪项内容？"))
        .when(F.col("_rule") == 4, F.lit("根据知识库内容，下列哪个时间或数值是正确的？"))
        .otherwise(said("关于“", title, "”，下列哪项表述与知识库一致？"))
    )
    answer = F.when(F.col("_rule") == 1, F.col("_value")).when(F.col("_rule") == 2, F.col("_mean")).when(F.col("_rule") == 3, F.col("_members")).when(F.col("_rule") == 4, F.col("_number")).otherwise(F.col("_s"))
    made = made.withColumns({"question": question, "answer": answer})
    return made.drop("_s", "_number", "_rule", *[f"_{n}" for n, *_ in _PARTS])


def facts_of_lines(rows: DataFrame, key: str, line: str, title: Column, *keep: str) -> DataFrame:
    """(key, *keep, question, answer, explanation) of lines of two characters or more."""
    cleaned = rows.withColumn("explanation", clean_line(line)).filter(F.length("explanation") >= 2)
    return with_facts(cleaned, "explanation", title).select(key, *keep, "question", "answer", "explanation")


def knowledge_base(parts: DataFrame, doc: str, most_facts: int | None = None) -> DataFrame:
    """Entries with keywords and facts from sections (doc, section, title, module, id, summary, body)."""
    ids = parts.withColumn("entry", F.concat_ws("#", F.col(doc), F.col("section")))
    first = F.element_at("body", 1)
    words = weighted_keywords(ids, "entry", [(F.col("title"), 3), (first, 2), (F.array_join(F.slice("body", 1, 6), " "), 1)])
    keywords = words.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    body = F.col("body") if most_facts is None else F.slice("body", 1, most_facts)
    rows = ids.select("entry", "title", F.posexplode(body).alias("at", "raw"))
    each = facts_of_lines(rows, "entry", "raw", F.col("title"), "at")
    listed = F.sort_array(F.collect_list(F.struct("at", F.struct("question", "answer", "explanation").alias("fact"))))
    facts = each.groupBy("entry").agg(F.transform(listed, lambda x: x["fact"]).alias("facts"))
    made = ids.join(keywords, "entry", "left").join(facts, "entry", "left")
    none = F.array().cast("array<struct<question:string,answer:string,explanation:string>>")
    return made.select(doc, "section", "id", "module", "title", "summary", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("facts", none).alias("facts"))


def inspect_report(docs: DataFrame, text: str, entries: DataFrame) -> DataFrame:
    """One row: documents, characters, entries and facts."""
    a = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("characters"))
    b = entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size("facts")), F.lit(0)).alias("facts"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
