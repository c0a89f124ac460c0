"""Queries on texts: functions, lines, sections, pages, keywords, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from ..operators import extract as X
from ..operators import pages as P
from ..operators import segment as S
from . import Registry
from . import duck as D
from . import rows as table

TEXTS = Registry()


def _flag(c):
    return F.coalesce(c, F.lit(False)).cast("int")


@TEXTS.add("normalize_slug", f"SELECT entry_no, {D.squeeze('title')} AS plain, {D.slug('title')} AS slug, {D.slug('title', f'[^a-zA-Z0-9_{T.CJK}]+')} AS word_slug, lower({D.compact('title')}) AS search_key FROM kb_entries")
def normalize_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kb_entries").select("entry_no", T.squeeze("title").alias("plain"), T.slug("title").alias("slug"), T.slug("title", "word").alias("word_slug"), T.search_key("title").alias("search_key"))


@TEXTS.add("clean_lines", f"""
WITH l AS (SELECT doc_id, unnest({D.lines('text')}) AS raw, generate_subscripts({D.lines('text')}, 1) - 1 AS line_no FROM documents),
c AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {D.clean('raw')} AS line FROM l)
SELECT doc_id, line_no, line, {D.flag(D.contact('line'))} AS contact, {D.flag(D.footer('line'))} AS footer, {D.flag(D.bullets('line'))} AS bullets FROM c WHERE line <> ''
""")
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    made = S.cleaned_lines(table(spark, sf, "documents"), "doc_id", "text")
    return made.select("doc_id", "line_no", "line", *[_flag(F.col(c)).alias(c) for c in ("contact", "footer", "bullets")])


def _entities(x: str) -> str:
    for name, to in T.ENTITIES.items():
        x = f"replace({x}, '&{name};', {D.lit(to)})"
    return x


_SCRIPTS = "regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"


@TEXTS.add("html_to_text", f"""
SELECT doc_id, regexp_replace(regexp_replace({_entities(_SCRIPTS)}, '<[^>]+>', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS plain FROM documents WHERE lower(suffix) IN ('.html', '.htm')
""")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").filter(F.lower("suffix").isin(".html", ".htm"))
    return pages.select("doc_id", T.html_text("text").alias("plain"))


_REPEATED = f"""
WITH f AS (SELECT DISTINCT lang, doc_id, unnest(list_filter(list_transform({D.lines('text')}, lambda l: {D.squeeze('l')}), lambda l: length(l) >= 8)) AS line FROM documents WHERE lang IS NOT NULL),
n AS (SELECT lang, count(*) AS total FROM documents WHERE {D.squeeze('text')} <> '' AND lang IS NOT NULL GROUP BY lang),
c AS (SELECT lang, line, count(*) AS pages FROM f GROUP BY lang, line),
r AS (SELECT lang, line, pages FROM c JOIN n USING (lang) WHERE pages >= greatest(2, floor(total * 0.0)) AND ({D.footer('line')} OR length(line) > 16))
"""


@TEXTS.add("repeated_lines", _REPEATED + "SELECT lang, line, pages FROM r")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A language as a document, its texts as pages; two pages are enough here."""
    return S.repeated_lines(table(spark, sf, "documents").filter("lang IS NOT NULL"), "lang", "doc_id", "text", share=0.0, least=2)


@TEXTS.add("page_clean", _REPEATED + f""",
l AS (SELECT lang, doc_id, unnest({D.lines('text')}) AS raw, generate_subscripts({D.lines('text')}, 1) - 1 AS line_no FROM documents WHERE lang IS NOT NULL),
k AS (SELECT lang, doc_id, CAST(line_no AS INTEGER) AS line_no, {D.squeeze(D.clean('raw'))} AS line FROM l)
SELECT lang, doc_id, line_no, line FROM k WHERE line <> '' AND NOT {D.contact('line')} AND NOT {D.footer('line')} AND NOT {D.bullets('line')} AND NOT EXISTS (SELECT 1 FROM r WHERE r.lang = k.lang AND r.line = k.line)
""")
def page_clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("lang IS NOT NULL")
    return S.clean_pages(docs, "lang", "doc_id", "text", S.repeated_lines(docs, "lang", "doc_id", "text", share=0.0, least=2))


_SECTIONS = f"""
WITH l AS (SELECT doc_id, title AS name, unnest({D.lines('text')}) AS raw, generate_subscripts({D.lines('text')}, 1) AS line_no FROM documents),
c AS (SELECT doc_id, name, line_no, {D.clean('raw')} AS line FROM l),
k AS (SELECT *, starts_with(line, '#') AS heading, sum(CAST(starts_with(line, '#') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM c WHERE line <> ''),
g AS (SELECT doc_id, any_value(name) AS name, section, max(trim(regexp_replace(line, '^[# ]+', ''))) FILTER (heading) AS head,
             list({D.clean('line')} ORDER BY line_no) FILTER (NOT heading AND {D.clean('line')} <> '') AS body FROM k GROUP BY doc_id, section),
s AS (SELECT doc_id, name, section, head, body FROM g WHERE len(body) > 0),
b AS (SELECT doc_id, title AS name, 0 AS section, NULL AS head, {D.clean_lines('text')} AS body FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)),
e AS (SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(nullif(head, ''), name, '') AS title, body FROM (SELECT * FROM s UNION ALL SELECT * FROM b WHERE len(body) > 0))
"""


@TEXTS.add("sections", _SECTIONS + f"""
SELECT doc_id, section, title, CASE WHEN contains(title, '►') THEN trim(split_part(title, '►', 1)) ELSE 'Imported Source' END AS module, {D.slug('title')} AS id, substr(body[1], 1, 120) AS summary, array_to_string(body, chr(10)) AS body FROM e
""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    made = S.sections(table(spark, sf, "documents"), "doc_id", "text", "title")
    return made.withColumn("body", F.array_join("body", "\n"))


_OWN_MODULE = r"nullif(CASE WHEN contains(trim(title), '►') THEN trim(split_part(trim(title), '►', 1)) WHEN trim(regexp_extract(trim(title), '第\d+讲(?:（\d+）)?\s*(\S.+)', 1)) <> '' THEN trim(regexp_extract(trim(title), '第\d+讲(?:（\d+）)?\s*(\S.+)', 1)) ELSE trim(regexp_extract(trim(title), '第[一二三四五六七八九十0-9]+章\s*(\S.+)', 1)) END, '')"


@TEXTS.add("module_carry", f"SELECT entry_no, coalesce(last_value({_OWN_MODULE} IGNORE NULLS) OVER (PARTITION BY module ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), module, '') AS carried FROM kb_entries")
def module_carry(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "kb_entries").select("entry_no", F.col("module").alias("doc"), "title")
    return S.carry_modules(entries, "doc", "entry_no", "title", F.coalesce("doc", F.lit(""))).select("entry_no", F.col("module").alias("carried"))


_SCORE = f"""(CASE WHEN length(l) BETWEEN 2 AND 36 THEN 4.0 WHEN length(l) <= 60 THEN 2.0 ELSE -2.0 END
 + CASE p WHEN 0 THEN 1.6 WHEN 1 THEN 1.1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 ELSE 0 END
 + CASE WHEN contains(l, '第') AND (contains(l, '讲') OR contains(l, '章')) THEN 3.2 ELSE 0 END
 + CASE WHEN contains(l, '►') OR contains(l, '内容概要') THEN 2.8 ELSE 0 END
 + CASE WHEN regexp_matches(l, '[A-Za-z{T.CJK}]') THEN 1.0 ELSE 0 END - CASE WHEN {D.contact('l')} THEN 5.0 ELSE 0 END - CASE WHEN ends_with(l, '...') THEN 1.0 ELSE 0 END)"""


@TEXTS.add("title_pick", f"""
WITH a AS (SELECT doc_id, coalesce(title, '') AS name, {D.clean_lines('text')}[1:6] AS ls FROM documents),
u AS (SELECT doc_id, name, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM a),
v AS (SELECT doc_id, name, l, i, list_position(ls, l) - 1 AS p FROM u),
r AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY round({_SCORE}, 4) DESC, i) AS place FROM v)
SELECT a.doc_id, coalesce(r.l, a.name) AS picked FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.place = 1
""")
def title_pick(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.slice(T.clean_lines("text"), 1, 6).alias("first"))
    return docs.select("doc_id", S.pick_title("first", F.col("title")).alias("picked"))


@TEXTS.add("wrapped_merge")
def wrapped_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A fold: each joined line decides about the next, which SQL over sets cannot say."""
    merged = S.merge_wrapped(T.lines("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(merged).alias("lines"), F.array_join(merged, "\n").alias("merged"))


def _flat(entries: DataFrame, doc: str, place: str) -> DataFrame:
    """Entries in columns that compare by value."""
    facts = F.transform("facts", lambda f: F.concat_ws("\t", f["question"], f["answer"]))
    pages = F.transform("pages", lambda p: p.cast("string"))
    return entries.select(doc, place, "id", "module", "title", "summary", F.array_join("keywords", ",").alias("keywords"), F.array_join(facts, "\n").alias("facts"), F.array_join(pages, ",").alias("pages"), "visual_signals.image_count")


@TEXTS.add("page_entries")
def page_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Texts under one title as the pages of a document; lines are folded, which SQL over sets cannot say."""
    docs = table(spark, sf, "documents").filter("suffix <> '.pptx'").select(F.col("title").alias("doc"), "doc_id", "text", F.lit(0).alias("images"), "title")
    return _flat(P.page_entries(docs, "doc", "doc_id", "text", "text", "images", "title"), "doc", "doc_id")


@TEXTS.add("slide_entries")
def slide_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Slides, their lines as blocks and no notes."""
    docs = table(spark, sf, "documents").filter("suffix = '.pptx'").select(F.col("source").alias("deck"), F.col("title").alias("doc"), "doc_id", F.array("title").alias("titles"), T.lines("text").alias("body"), F.lit(None).cast("array<string>").alias("notes"), F.lit(0).alias("images"))
    return _flat(P.slide_entries(docs, "doc", "doc_id", "titles", "body", "notes", "images", "deck"), "doc", "doc_id")


@TEXTS.add("fingerprint_dedup", f"""
WITH a AS (SELECT source, doc_id, title, length(coalesce(text, '')) AS images, array_to_string(list_filter(list_transform(list_concat([''], {D.clean_lines('text')}[1:12]), lambda l: {D.compact('l')}), lambda l: l <> ''), chr(1)) AS print FROM documents)
SELECT source, min(doc_id) AS doc_id, arg_min(coalesce(title, ''), doc_id) AS title, array_to_string(list(doc_id ORDER BY doc_id), ',') AS pages, CAST(max(images) AS BIGINT) AS images FROM a GROUP BY source, print
""")
def fingerprint_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source with equal first lines, as one."""
    docs = table(spark, sf, "documents").select("source", "doc_id", F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("blank"), T.clean_lines("text").alias("body"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    made = docs.withColumn("print", S.fingerprint("blank", "body")).groupBy("source", "print").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title"), F.sort_array(F.collect_list("doc_id")).alias("pages"), F.max("size").cast("long").alias("images")
    )
    return made.select("source", "doc_id", "title", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "images")


def _tokens_sql(x: str, n: int, w: int) -> str:
    return f"SELECT doc_id, unnest({D.keyword_tokens(x)}) AS keyword, {w} AS weight, {n * 1_000_000} + generate_subscripts({D.keyword_tokens(x)}, 1) AS spot FROM a"


@TEXTS.add("keyword_topk", f"""
WITH a AS (SELECT doc_id, coalesce(title, '') AS title, {D.clean_lines('text')} AS body FROM documents),
t AS ({_tokens_sql('title', 0, 3)} UNION ALL {_tokens_sql("coalesce(body[1], '')", 1, 2)} UNION ALL {_tokens_sql("array_to_string(body[1:6], ' ')", 2, 1)}),
g AS (SELECT doc_id, keyword, sum(weight) AS score, min(spot) AS early FROM t GROUP BY doc_id, keyword),
r AS (SELECT doc_id, keyword, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, early) AS place FROM g)
SELECT doc_id, CAST(place AS INTEGER) AS place, keyword, CAST(score AS BIGINT) AS score FROM r WHERE place <= 8
""")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), T.clean_lines("text").alias("body"))
    first = F.coalesce(F.get("body", F.lit(0)), F.lit(""))
    return X.weighted_keywords(docs, "doc_id", [(F.col("title"), 3), (first, 2), (F.array_join(F.slice("body", 1, 6), " "), 1)])


def _fact_sql() -> str:
    s = "s"
    a = lambda p, k, m: f"trim(regexp_extract({s}, {D.lit(p)}, {k}), {D.lit(m)})"
    name, value = a(X.MAPPED, 1, " "), a(X.MAPPED, 2, "。 ")
    thing, mean = a(X.DEFINED, 1, "：:，, "), a(X.DEFINED, 2, "。 ，,")
    whole, part = a(X.CONTAINED, 1, "：:，, "), a(X.CONTAINED, 2, "。 ，,")
    number = f"trim(regexp_extract({s}, {D.lit(X.QUANTITY)}, 1))"
    fit = lambda x, y: f"length({x}) BETWEEN 2 AND 40 AND length({y}) BETWEEN 1 AND 80"
    cases = (
        (f"length({value}) BETWEEN 1 AND 80", f"'“' || {name} || '”对应的内容是？'", value),
        (fit(thing, mean), f"'关于“' || {thing} || '”，下列哪项表述正确？'", mean),
        (fit(whole, part), f"'“' || {whole} || '”包括下列哪项内容？'", part),
        (f"{number} <> ''", "'根据知识库内容，下列哪个时间或数值是正确的？'", number),
    )
    q = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x, _ in cases) + " ELSE '关于“' || name || '”，下列哪项表述与知识库一致？' END"
    v = "CASE " + " ".join(f"WHEN {c} THEN {y}" for c, _, y in cases) + " ELSE s END"
    return f"{q} AS question, {v} AS answer"


@TEXTS.add("fact_lines", f"""
WITH l AS (SELECT doc_id, coalesce(title, '') AS name, unnest({D.lines('text')}) AS raw, generate_subscripts({D.lines('text')}, 1) - 1 AS line_no FROM documents),
c AS (SELECT doc_id, name, CAST(line_no AS INTEGER) AS line_no, {D.clean('raw')} AS line FROM l),
s AS (SELECT *, trim({D.clean('line')}, '。') AS s FROM c WHERE length(line) >= 2)
SELECT doc_id, line_no, {_fact_sql()}, line AS explanation FROM s
""")
def fact_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.exploded_lines(table(spark, sf, "documents"), "doc_id", "text", "title").withColumn("name", F.coalesce("title", F.lit("")))
    return X.facts_of_lines(rows, "doc_id", "raw", F.col("name"), "line_no")


@TEXTS.add("knowledge_base", _SECTIONS + "SELECT doc_id, section, title, len(list_filter(body, lambda l: length(" + D.clean("l") + ") >= 2)) AS facts FROM e")
def knowledge_base(spark: SparkSession, sf: str) -> DataFrame:
    parts = S.sections(table(spark, sf, "documents"), "doc_id", "text", "title")
    return X.knowledge_base(parts, "doc_id").select("doc_id", "section", "title", F.size("facts").cast("long").alias("facts"))


@TEXTS.add("inspect_report", _SECTIONS + "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(length(coalesce(text, ''))) FROM documents)::BIGINT AS characters, count(*) AS entries, sum(len(list_filter(body, lambda l: length(" + D.clean("l") + ") >= 2)))::BIGINT AS facts FROM e")
def inspect_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return X.inspect_report(docs, "text", X.knowledge_base(S.sections(docs, "doc_id", "text", "title"), "doc_id"))


@TEXTS.add("answer_signature", f"SELECT fact_id, {D.signature('answer')} AS signature, {D.bucket('answer')} AS bucket FROM kb_facts")
def answer_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kb_facts").select("fact_id", Q.answer_signature("answer").alias("signature"), Q.surface_bucket("answer").alias("bucket"))


@TEXTS.add("distractor_fit", f"""
WITH d AS (SELECT fact_id, answer, unnest(distractors) AS text, generate_subscripts(distractors, 1) - 1 AS place FROM kb_facts)
SELECT fact_id, CAST(place AS INTEGER) AS place, {D.flag(D.fits(D.signature('answer'), D.signature('text')))} AS fits, {D.flag(D.bad_option('text'))} AS bad FROM d
""")
def distractor_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "kb_facts").select("fact_id", "answer", F.posexplode("distractors").alias("place", "text"))
    return rows.select("fact_id", "place", _flag(Q.signatures_fit(Q.answer_signature("answer"), Q.answer_signature("text"))).alias("fits"), _flag(Q.is_bad_option("text")).alias("bad"))


_TITLE, _OWN = f"list_distinct({D.search_tokens('title')})", f"list_distinct({D.search_tokens('answer')})"


@TEXTS.add("fact_usable", f"""
SELECT fact_id, {D.flag(f'''({D.squeeze('answer')} <> '' AND length({D.squeeze('answer')}) <= 96 AND NOT {D.low_information('answer')}
  AND NOT (len({_TITLE}) > 0 AND len({_OWN}) > 0 AND len(list_intersect({_TITLE}, {_OWN})) >= 0.8 * len({_TITLE}) AND len({_OWN}) <= len({_TITLE}) + 2))''')} AS usable
FROM kb_facts JOIN kb_entries USING (entry_no)
""")
def fact_usable(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "kb_facts").select("fact_id", "entry_no", "answer")
    titles = table(spark, sf, "kb_entries").select("entry_no", "title")
    return facts.join(titles, "entry_no").select("fact_id", _flag(Q.is_usable_fact("title", "answer")).alias("usable"))


@TEXTS.add("prompt_focus", f"SELECT row_id, {D.focus('prompt')} AS focus, {D.flag(D.noisy(D.focus('prompt')))} AS noisy, {D.flag(D.generic('prompt'))} AS generic, {D.flag(D.low_information('analysis'))} AS poor FROM question_bank")
def prompt_focus(spark: SparkSession, sf: str) -> DataFrame:
    focus = Q.prompt_focus("prompt")
    bank = table(spark, sf, "question_bank")
    return bank.select("row_id", focus.alias("focus"), _flag(Q.is_noisy_focus(focus)).alias("noisy"), _flag(Q.is_generic_prompt("prompt")).alias("generic"), _flag(T.is_low_information("analysis")).alias("poor"))


@TEXTS.add("page_search", f"SELECT doc_id, CASE WHEN instr(lower(text), '内含子') > 0 THEN substr(text, greatest(instr(lower(text), '内含子') - 10, 1), instr(lower(text), '内含子') + 40 - greatest(instr(lower(text), '内含子') - 10, 1)) ELSE substr(text, 1, 50) END AS snippet FROM documents WHERE contains(lower({D.compact('text')}), '内含子')")
def page_search(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.browse import page_search as search

    return search(table(spark, sf, "documents"), "doc_id", "text", "内含子")
