"""Queries on banks: retrieval, assembly, upkeep, browsing, grading, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import rules as U
from ..functions import text as T
from ..operators import assemble as A
from ..operators import bank as B
from ..operators import browse as W
from ..operators import figures as I
from ..operators import grading as G
from ..operators import retrieve as R
from ..operators import segment as S
from ..operators import toplists as L
from . import Registry
from . import duck as D
from . import rows as table

BANKS = Registry()
_OPTIONS = "coalesce(options, [])"
_IMAGE = "(coalesce(images.question, '') <> '')"


def _flag(c):
    return F.coalesce(c, F.lit(False)).cast("int")


def _image():
    return F.coalesce("images.question", F.lit("")) != ""


# Retrieval -----------------------------------------------------------------------

_ASKED = "coalesce(question, '') || ' ' || coalesce(answer, '') || ' ' || coalesce(explanation, '')"
_HELD = "coalesce(prompt, '') || ' ' || coalesce(analysis, '') || ' ' || coalesce(topic_name, '')"
_TERMS = f"""
WITH d AS (SELECT DISTINCT row_id, unnest({D.search_tokens(_HELD)}) AS term FROM question_bank),
q AS (SELECT DISTINCT fact_id, unnest({D.search_tokens(_ASKED)}) AS term FROM kb_facts WHERE fact_id % 50 = 0),
s AS (SELECT row_id, count(*) AS size FROM d GROUP BY row_id),
m AS (SELECT count(*) AS n, avg(size) AS mean FROM s),
f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
w AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f, m),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w) ELSE raw END AS idf FROM w),
b AS (SELECT fact_id, row_id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * size / mean))), 9) AS bm25 FROM q JOIN d USING (term) JOIN i USING (term) JOIN s USING (row_id), m GROUP BY fact_id, row_id)
"""


#: The same for all facts.
_ALL_TERMS = _TERMS.replace(" WHERE fact_id % 50 = 0", "")


def _bank_texts(spark: SparkSession, sf: str, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """What is searched of every fact as a query, and of every question, each with its type."""
    text = lambda *c: F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c])
    facts = table(spark, sf, "kb_facts").filter(only).select("fact_id", text("question", "answer", "explanation").alias("t"), "type")
    return facts, table(spark, sf, "question_bank").select("row_id", text("prompt", "analysis", "topic_name").alias("t"), "type")


def _bank_tokens(spark: SparkSession, sf: str, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """Terms in order of every fact as a query, and of every question."""
    facts, bank = _bank_texts(spark, sf, only)
    return facts.select("fact_id", T.search_tokens("t").alias("ts")), bank.select("row_id", T.search_tokens("t").alias("ts"))


@BANKS.add("bm25_topk", _ALL_TERMS + "SELECT fact_id, CAST(place AS INTEGER) AS place, row_id, round(bm25, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY round(bm25, 6) DESC, row_id) AS place FROM b) WHERE place <= 5")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked, held = _bank_texts(spark, sf)
    return L.TermIndex(held, "row_id", "t", asked, "fact_id", "t").best_relevance(5).withColumnRenamed("score", "bm25")


def _paired(x: str) -> str:
    t = D.in_order(D.search_tokens(x))
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


@BANKS.add("tfidf_topk", f"""
WITH dt AS (SELECT row_id, {D.in_order(D.search_tokens("prompt"))} AS ts FROM question_bank),
qt AS (SELECT fact_id, {D.in_order(D.search_tokens("question"))} AS ts FROM kb_facts),
d AS (SELECT DISTINCT row_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM dt),
q AS (SELECT DISTINCT fact_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM qt),
n AS (SELECT count(*) AS n FROM question_bank),
w AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS w FROM (SELECT term, count(*) AS df FROM d GROUP BY term), n),
nd AS (SELECT row_id, sqrt(sum(w * w)) AS nd FROM d JOIN w USING (term) GROUP BY row_id),
nq AS (SELECT fact_id, sqrt(sum(w * w)) AS nq FROM q JOIN w USING (term) GROUP BY fact_id),
c AS (SELECT fact_id, row_id, sum(w * w) AS dot FROM q JOIN d USING (term) JOIN w USING (term) GROUP BY fact_id, row_id),
r AS (SELECT fact_id, row_id, round(dot / (nd * nq), 6) AS tfidf FROM c JOIN nd USING (row_id) JOIN nq USING (fact_id))
SELECT fact_id, CAST(place AS INTEGER) AS place, row_id, tfidf FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY tfidf DESC, row_id) AS place FROM r) WHERE place <= 5
""")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "kb_facts").select("fact_id", "question")
    bank = table(spark, sf, "question_bank").select("row_id", "prompt")
    return L.TermIndex(bank, "row_id", "prompt", facts, "fact_id", "question", pairs=True).best_cosine(5, bank.count()).withColumnRenamed("score", "tfidf")


@BANKS.add("semantic_topk", """
WITH c AS (SELECT a.vec_id AS query, b.vec_id AS other, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query, CAST(place AS INTEGER) AS place, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, other) AS place FROM c) WHERE place <= 5
""")
def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.nearest_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


def _asked_and_prompts(spark: SparkSession, sf: str, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """Questions of all facts, and the prompts of all questions, each with its type."""
    facts = table(spark, sf, "kb_facts").filter(only).select("fact_id", T.squeeze("question").alias("question"), F.col("type").alias("wanted"))
    return facts, table(spark, sf, "question_bank").select("row_id", T.squeeze("prompt").alias("prompt"), "type")


@BANKS.add("fuzzy_topk")
def fuzzy_topk(spark: SparkSession, sf: str) -> DataFrame:
    facts, bank = _asked_and_prompts(spark, sf, "fact_id % 50 = 0")
    likest = R.likest_texts(bank, "row_id", "prompt", facts, "fact_id", "question", 5)
    return R.top(likest, "fact_id", [F.desc("fuzzy"), F.col("row_id")], 5).select("fact_id", "place", "row_id", "fuzzy")


@BANKS.add("hybrid_rank")
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance, cosine of terms and pairs, and letters, each normalised over all rows, and a bonus for the type."""
    facts, bank = _asked_and_prompts(spark, sf)
    asked, held = _bank_tokens(spark, sf)
    return R.hybrid(bank, "row_id", "prompt", "type", held, facts, "fact_id", "question", "wanted", asked, 5)


@BANKS.add("lexical_rank", _TERMS + """,
z AS (SELECT *, least(min(bm25) OVER p, CASE WHEN count(*) OVER p < n THEN 0 ELSE min(bm25) OVER p END) AS low, greatest(max(bm25) OVER p, CASE WHEN count(*) OVER p < n THEN 0 ELSE max(bm25) OVER p END) AS high FROM b, m WINDOW p AS (PARTITION BY fact_id)),
y AS (SELECT fact_id, z.row_id, round(0.45 * CASE WHEN abs(high - low) < 1e-9 THEN CASE WHEN high > 0 THEN 1.0 ELSE 0.0 END ELSE (bm25 - low) / (high - low) END + CASE WHEN f.type = k.type THEN 0.08 ELSE 0 END, 6) AS score FROM z JOIN kb_facts f USING (fact_id) JOIN question_bank k ON k.row_id = z.row_id)
SELECT fact_id, CAST(place AS INTEGER) AS place, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, row_id) AS place FROM y) WHERE place <= 5
""")
def lexical_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised and fused scores without those that SQL cannot say."""
    asked, held = _bank_texts(spark, sf, "fact_id % 50 = 0")
    return L.TermIndex(held, "row_id", "t", asked, "fact_id", "t", kind="type", wanted="type").best_lexical(5)


_ENTRY_TERMS = f"list_distinct(list_concat(list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL), {D.search_tokens('title')}))"


@BANKS.add("entry_similarity", f"""
WITH e AS (SELECT entry_no, coalesce(module, '') AS module, {_ENTRY_TERMS} AS ts FROM kb_entries),
p AS (SELECT a.entry_no, b.entry_no AS other, CASE WHEN a.module <> '' AND a.module = b.module THEN 3 ELSE 0 END + len(list_intersect(a.ts, b.ts)) AS score FROM e a JOIN e b ON a.entry_no % 50 = 0 AND a.entry_no <> b.entry_no)
SELECT entry_no, CAST(place AS INTEGER) AS place, other, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entry_no ORDER BY score DESC, other) AS place FROM p WHERE score > 0) WHERE place <= 10
""")
def entry_similarity(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "kb_entries").select("entry_no", F.coalesce("module", F.lit("")).alias("module"), "title", "keywords")
    words = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull())
    return A.similar_entries(entries, "entry_no", "module", F.concat(words, T.search_tokens("title")), F.col("e") % 50 == 0, 10)


# Assembly ------------------------------------------------------------------------


@BANKS.add("distractor_pool", f"""
WITH d AS (SELECT f.entry_no, fact_id, list_filter(list_transform(coalesce(distractors, []), lambda t: {D.squeeze('t')}), lambda t: t <> '') AS ts FROM kb_facts f),
b AS (SELECT *, coalesce(sum(len(ts)) OVER (PARTITION BY entry_no ORDER BY fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT entry_no, fact_id, array_to_string(ts, chr(1)) AS texts FROM b WHERE before < 24 AND len(ts) > 0
""")
def distractor_pool(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.filter(F.transform(F.coalesce("distractors", F.array().cast("array<string>")), T.squeeze), lambda t: t != "")
    facts = table(spark, sf, "kb_facts").select("entry_no", "fact_id", texts.alias("texts"))
    return A.distractor_pool(facts, "entry_no", "fact_id", "texts").select("entry_no", "fact_id", F.array_join("texts", "\u0001").alias("texts"))


@BANKS.add("build_options", f"""
WITH f AS (SELECT fact_id, {D.squeeze('answer')} AS a, list_filter(list_transform(coalesce(distractors, []), lambda t: {D.squeeze('t')}), lambda t: t <> '')[1:3] AS ds FROM kb_facts),
g AS (SELECT fact_id, a, list_concat([a], ds, list_transform(range(len(ds) + 1, 4), lambda i: '{A.FILLER}' || i)) AS ts FROM f),
o AS (SELECT fact_id, a, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS i FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY md5('7|' || fact_id || '|' || i || '|' || text), text) AS place FROM o)
SELECT fact_id, substr('ABCD', place, 1) AS key, text FROM k
""")
def build_options(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    made = table(spark, sf, "kb_facts").select("fact_id", A.options_of("answer", "distractors", none, 7, "fact_id").alias("options"))
    return made.select("fact_id", F.inline("options"))


_ADAPTED = f"""CASE WHEN NOT {D.generic('question')} THEN {D.squeeze('question')} WHEN {D.signature('answer')} = 'numeric' THEN '关于“' || {D.squeeze('title')} || '”，下列哪个时间或数值是正确的？'
 WHEN {D.signature('answer')} = 'acronym' THEN '关于“' || {D.squeeze('title')} || '”，下列哪一项术语或缩写是正确的？' WHEN {D.signature('answer')} = 'command' THEN '关于“' || {D.squeeze('title')} || '”，下列哪项命令或参数写法是正确的？'
 ELSE '关于“' || {D.squeeze('title')} || '”，下列哪项表述正确？' END"""


@BANKS.add("prompt_adapt", f"SELECT fact_id, {_ADAPTED} AS prompt FROM kb_facts JOIN kb_entries USING (entry_no)")
def prompt_adapt(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "kb_facts").select("fact_id", "entry_no", "question", "answer")
    titles = table(spark, sf, "kb_entries").select("entry_no", "title")
    return facts.join(titles, "entry_no").select("fact_id", A.adapted_prompt("question", "title", "answer").alias("prompt"))


def _cue(x: str) -> str:
    s = D.squeeze(x)
    for p in A.CUE_CLEANUPS:
        s = f"regexp_replace({s}, {D.lit(p)}, '', 'g')"
    return f"trim(regexp_replace({s}, {D.lit(T.SPACE + '+')}, ' ', 'g'), {D.lit('，,。:：;；“”' + chr(34) + chr(39) + ' ')})"


@BANKS.add("prompt_rewrite", f"""
WITH f AS (SELECT fact_id, {_cue('question')} AS cue, {D.squeeze('title')} AS name, {D.signature('answer')} AS kind FROM kb_facts JOIN kb_entries USING (entry_no))
SELECT fact_id, CASE WHEN cue <> '' AND cue <> name THEN '在“' || name || '”这一主题中，与“' || cue || CASE kind WHEN 'numeric' THEN '”相关的正确时间或数值是？' WHEN 'acronym' THEN '”对应的术语或缩写是？' WHEN 'command' THEN '”相关的正确工具或参数写法是？' ELSE '”直接相关的正确表述是？' END
 ELSE '围绕“' || name || CASE kind WHEN 'numeric' THEN '”，下列哪个时间或数值最合适？' WHEN 'acronym' THEN '”，下列哪个术语或缩写最合适？' WHEN 'command' THEN '”，下列哪项工具或参数写法最合适？' ELSE '”，下列哪项说法最合适？' END END AS prompt FROM f
""")
def prompt_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "kb_facts").select("fact_id", "entry_no", "question", "answer")
    titles = table(spark, sf, "kb_entries").select("entry_no", "title")
    return facts.join(titles, "entry_no").select("fact_id", A.rewritten_prompt("question", "title", "answer").alias("prompt"))


_TEXTS = f"list_transform({_OPTIONS}, lambda o: {D.squeeze('o.text')})"
_QUALITY = f"""
WITH q AS (SELECT row_id, {D.squeeze('prompt')} AS p, {D.squeeze('analysis')} AS n, {_TEXTS} AS ts, {D.squeeze(f"list_filter({_OPTIONS}, lambda o: o.key = answer)[1].text")} AS r FROM question_bank),
k AS (SELECT *, {D.focus('p')} AS f, CASE WHEN r = '' THEN 'short_phrase' ELSE {D.signature('r')} END AS kind, list_transform(ts, lambda t: {D.signature('t')}) AS ks, list_transform(ts, lambda t: {D.bucket('t')}) AS bs FROM q),
z AS (SELECT *, list_transform(list_distinct(bs), lambda b: len(list_filter(bs, lambda x: x = b))) AS sizes FROM k),
i AS (SELECT row_id, list_filter([
  CASE WHEN length(p) < 8 THEN 'prompt-too-short' END, CASE WHEN contains(p, '�') OR contains(n, '�') THEN 'ocr-noise' END, CASE WHEN f <> '' AND {D.noisy('f')} THEN 'noisy-focus' END,
  CASE WHEN contains(p, '命令或参数写法') AND kind <> 'command' THEN 'prompt-answer-mismatch-command' END, CASE WHEN (contains(p, '时间或数值') OR contains(p, '哪一年')) AND kind <> 'numeric' THEN 'prompt-answer-mismatch-numeric' END,
  CASE WHEN contains(p, '术语或缩写') AND kind NOT IN ('acronym', 'short_phrase', 'short_cjk') THEN 'prompt-answer-mismatch-acronym' END, CASE WHEN contains(p, '对应的内容是') AND f <> '' AND {D.noisy('f')} THEN 'mapping-fragment' END,
  CASE WHEN len(list_filter(ts, lambda t: {D.bad_option('t')})) > 0 THEN 'bad-option' END, CASE WHEN len(ts) > 0 AND len(list_filter(ks, lambda x: {D.fits('kind', 'x')})) < greatest(2, len(ts) - 1) THEN 'option-signature-mismatch' END,
  CASE WHEN f <> '' AND {D.has('lower(f)', Q.ATTRIBUTES)} AND len(ts) >= 4 AND len(sizes) >= 2 AND list_max(sizes) = len(ts) - 1 AND list_min(sizes) = 1 THEN 'attribute-option-mismatch' END,
  CASE WHEN n <> '' AND {D.low_information('n')} THEN 'low-information-analysis' END], lambda x: x IS NOT NULL) AS issues FROM z)
"""


@BANKS.add("quality_issues", _QUALITY + "SELECT row_id, array_to_string(issues, ',') AS issues FROM i")
def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "question_bank").select("row_id", F.array_join(Q.quality_issues("prompt", "analysis", "options", "answer"), ",").alias("issues"))


@BANKS.add("greedy_select", _QUALITY + """,
c AS (SELECT q.row_id, trim(q.p) AS prompt, difficulty FROM q JOIN i USING (row_id) JOIN question_bank USING (row_id) WHERE len(issues) = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY difficulty DESC NULLS LAST, md5('7|' || row_id), row_id) AS n FROM c)
SELECT row_id, prompt FROM f WHERE n = 1 ORDER BY difficulty DESC NULLS LAST, md5('7|' || row_id), row_id LIMIT 200
""")
def greedy_select(spark: SparkSession, sf: str) -> DataFrame:
    bank = table(spark, sf, "question_bank")
    good = F.size(Q.quality_issues("prompt", "analysis", "options", "answer")) == 0
    made = bank.select("row_id", T.squeeze("prompt").alias("prompt"), "difficulty", good.alias("good"))
    rank = [F.desc_nulls_last("difficulty"), A.seeded(7, "row_id"), F.col("row_id")]
    return A.select_questions(made, "prompt", rank, F.col("good"), 200).select("row_id", "prompt")


# Upkeep --------------------------------------------------------------------------


@BANKS.add("bank_upsert", """
WITH a AS (SELECT 0 AS batch, row_id, id, prompt, answer FROM question_bank UNION ALL SELECT 1, row_id, id, prompt, answer FROM incoming_questions),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC, row_id DESC) AS last, first_value(batch) OVER w AS first_batch, first_value(row_id) OVER w AS first_order FROM a WINDOW w AS (PARTITION BY id ORDER BY batch, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT row_id, id, prompt, answer, first_batch, first_order FROM r WHERE last = 1
""")
def bank_upsert(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["row_id", "id", "prompt", "answer"]
    return B.upsert(table(spark, sf, "question_bank").select(columns), table(spark, sf, "incoming_questions").select(columns), "id", "row_id")


@BANKS.add("bank_meta", f"""
WITH q AS (SELECT row_id, coalesce(topic, 'unknown') AS topic, coalesce(type, 'single_choice') AS type, coalesce(source, 'Unknown') AS source, topic_name, {_IMAGE} AS image, (coalesce(images.note, '') <> '') AS note FROM question_bank),
g AS (SELECT topic, type, source, grouping(topic) * 4 + grouping(type) * 2 + grouping(source) AS g, arg_min(topic_name, row_id) AS label, count(*) AS questions, count(*) FILTER (image) AS with_image, count(*) FILTER (note) AS with_note FROM q GROUP BY GROUPING SETS ((topic), (type), (source), ()))
SELECT CASE g WHEN 3 THEN 'topic' WHEN 5 THEN 'type' WHEN 6 THEN 'source' ELSE 'all' END AS facet, coalesce(topic, type, source, '') AS value, CASE WHEN g = 3 THEN label END AS label, questions, with_image, with_note FROM g
""")
def bank_meta(spark: SparkSession, sf: str) -> DataFrame:
    return B.roll_up(table(spark, sf, "question_bank"))


@BANKS.add("facets", "SELECT coalesce(source, 'Unknown') AS source, count(*) AS questions FROM question_bank GROUP BY 1")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    return W.facet_counts(table(spark, sf, "question_bank"), "source")


_LATEST = """
WITH l AS (SELECT question_id, record_id, answer, checked, correct, updated_at, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(updated_at, TIMESTAMP '0001-01-01') DESC, received_at DESC, record_id DESC) AS n FROM answer_records WHERE question_id IS NOT NULL),
a AS (SELECT question_id, record_id, answer, checked, correct FROM l WHERE n = 1 AND answer IS NOT NULL)
"""


@BANKS.add("latest_answers", _LATEST + f"SELECT question_id, record_id, answer, {D.flag('coalesce(checked, false)')} AS checked, {D.flag('coalesce(correct, false)')} AS correct FROM a")
def latest_answers(spark: SparkSession, sf: str) -> DataFrame:
    last = G.latest_answers(table(spark, sf, "answer_records"))
    return last.select("question_id", "record_id", "answer", _flag(F.col("checked")).alias("checked"), _flag(F.col("correct")).alias("correct"))


_GRADED = _LATEST + f""",
k AS (SELECT id AS question_id, type, answer AS expected FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) AS n FROM question_bank) WHERE n = 1),
j AS (SELECT question_id, record_id, type, lower({D.compact('a.answer')}) AS g, lower({D.compact('expected')}) AS e FROM a JOIN k USING (question_id)),
r AS (SELECT question_id, record_id, CASE WHEN type = 'multiple_choice' THEN array_to_string(list_sort(string_split(g, '')), '') = e WHEN type = 'single_choice' THEN g = e ELSE e = '' OR (g <> '' AND (contains(g, e) OR contains(e, g))) END AS right_ FROM j)
"""


@BANKS.add("grade_answers", _GRADED + f"SELECT question_id, record_id, {D.flag('right_')} AS is_right FROM r")
def grade_answers(spark: SparkSession, sf: str) -> DataFrame:
    made = G.grade(G.latest_answers(table(spark, sf, "answer_records")), table(spark, sf, "question_bank"))
    return made.select("question_id", "record_id", _flag(F.col("right")).alias("is_right"))


@BANKS.add("kpis", _GRADED + f"SELECT (SELECT count(*) FROM question_bank) AS questions, (SELECT count(*) FROM question_bank WHERE {_IMAGE}) AS with_image, (SELECT count(*) FROM kb_entries) AS entries, count(*) AS answered, count(*) FILTER (right_) AS correct FROM r")
def kpis(spark: SparkSession, sf: str) -> DataFrame:
    one = F.lit(1).alias("one")
    bank = table(spark, sf, "question_bank").agg(F.count(F.lit(1)).alias("questions"), F.count_if(_image()).alias("with_image")).select("*", one)
    entries = table(spark, sf, "kb_entries").agg(F.count(F.lit(1)).alias("entries")).select("*", one)
    graded = G.grade(G.latest_answers(table(spark, sf, "answer_records")), table(spark, sf, "question_bank"))
    answers = graded.agg(F.count(F.lit(1)).alias("answered"), F.count_if("right").alias("correct")).select("*", one)
    return bank.join(entries, "one").join(answers, "one").drop("one")


@BANKS.add("browse_filter", f"""
SELECT row_id FROM question_bank WHERE type = 'single_choice' AND contains(lower({D.compact("concat_ws(' ', coalesce(prompt, ''), coalesce(answer, ''), coalesce(analysis, ''), coalesce(topic_name, ''), array_to_string(coalesce(tags, []), ' '), array_to_string(list_transform(coalesce(options, []), lambda o: o.text), ' '))")}), '内含子')
""")
def browse_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "question_bank").filter(W.Filters(type="single_choice", search=" 内含 子").condition()).select("row_id")


_REFS = "SELECT row_id, unnest(list_distinct(coalesce(knowledge_refs, []))) AS ref FROM question_bank"


@BANKS.add("module_questions", f"WITH r AS ({_REFS}), e AS (SELECT DISTINCT id FROM kb_entries) SELECT e.id, count(r.row_id) AS questions FROM e LEFT JOIN r ON r.ref = e.id GROUP BY e.id")
def module_questions(spark: SparkSession, sf: str) -> DataFrame:
    return B.entry_questions(table(spark, sf, "kb_entries"), "id", table(spark, sf, "question_bank"), "row_id", "knowledge_refs")


@BANKS.add("first_module", "WITH r AS (SELECT row_id, unnest(knowledge_refs) AS id, generate_subscripts(knowledge_refs, 1) AS spot FROM question_bank) SELECT row_id, arg_min(id, spot) AS id FROM r WHERE id IN (SELECT id FROM kb_entries) GROUP BY row_id")
def first_module(spark: SparkSession, sf: str) -> DataFrame:
    return B.first_entries(table(spark, sf, "question_bank"), "row_id", "knowledge_refs", table(spark, sf, "kb_entries"), "id")


@BANKS.add("sample_quiz", "SELECT row_id FROM question_bank WHERE type IN ('single_choice', 'multiple_choice') ORDER BY md5('11|' || row_id), row_id LIMIT 50")
def sample_quiz(spark: SparkSession, sf: str) -> DataFrame:
    pool = table(spark, sf, "question_bank").filter(F.col("type").isin("single_choice", "multiple_choice")).select("row_id")
    return W.sample(pool, "row_id", 50, 11)


_RULES = "CASE " + " ".join(f"WHEN {D.has('lower(coalesce(prompt, ' + chr(39) * 2 + '))', '|'.join(w.lower() for w in words))} THEN '{topic}'" for topic, words in U.TOPIC_RULES.items()) + " ELSE 'general' END"
_LETTERS = D.compact("answer")
_TYPED = f"CASE WHEN {D.has(_LETTERS, '^[A-Z]+$')} AND len(list_filter(string_split({_LETTERS}, ''), lambda c: NOT list_contains(list_transform({_OPTIONS}, lambda o: o.key), c))) = 0 THEN CASE WHEN contains(coalesce(prompt, ''), '[多选]') OR length({_LETTERS}) > 1 THEN 'multiple_choice' ELSE 'single_choice' END WHEN len({_OPTIONS}) > 0 THEN 'short_answer' ELSE 'open_ended' END"
_CLASSED = f"WITH c AS (SELECT row_id, prompt, analysis, options, {_RULES} AS topic, {_TYPED} AS kind, {_IMAGE} AS image FROM question_bank)"


@BANKS.add("classify", _CLASSED + f"""
SELECT row_id, topic, kind, least(5, 2 + {D.flag("kind = 'multiple_choice'")} + {D.flag("kind IN ('short_answer', 'open_ended')")} + {D.flag('image')} + {D.flag(D.has("lower(coalesce(prompt, ''))", U.COMPUTED))} + {D.flag(f'len({_OPTIONS}) <= 2')}) AS difficulty,
 array_to_string(list_sort(list_distinct(list_filter([topic, kind, CASE WHEN image THEN 'image-based' END, CASE WHEN contains(coalesce(prompt, ''), '[多选]') THEN 'multi-select' END, {", ".join(f"CASE WHEN {D.has("lower(coalesce(prompt, '') || ' ' || coalesce(analysis, ''))", rule)} THEN '{tag}' END" for tag, rule in U.TAG_RULES.items())}], lambda x: x IS NOT NULL))), ',') AS tags FROM c
""")
def classify(spark: SparkSession, sf: str) -> DataFrame:
    kind = U.type_of("answer", "prompt", "options").alias("kind")
    made = table(spark, sf, "question_bank").select("row_id", "prompt", "analysis", U.topic_of("prompt").alias("topic"), kind, _image().alias("image"), F.size(F.coalesce("options", F.array().cast("array<struct<key:string,text:string>>"))).alias("n"))
    tags = F.array_join(U.tags_of("prompt", "analysis", F.col("topic"), F.col("kind"), F.col("image")), ",")
    return made.select("row_id", "topic", "kind", U.difficulty_of("prompt", F.col("kind"), F.col("image"), F.col("n")).alias("difficulty"), tags.alias("tags"))


@BANKS.add("topic_details", "SELECT row_id, coalesce(t.topic_name, 'none') AS canonical, coalesce(t.module, 'none') AS module FROM question_bank q LEFT JOIN topics t USING (topic)")
def topic_details(spark: SparkSession, sf: str) -> DataFrame:
    topics = table(spark, sf, "topics").select("topic", F.col("topic_name").alias("canonical"), "module")
    return B.with_details(table(spark, sf, "question_bank").select("row_id", "topic"), topics, "topic", {"canonical": "none", "module": "none"}).select("row_id", "canonical", "module")


@BANKS.add("renumber", r"""
WITH s AS (SELECT topic, coalesce(max(CAST(nullif(regexp_extract(coalesce(id, ''), '-(\d{3})$', 1), '') AS INTEGER)), 0) AS serial FROM question_bank GROUP BY topic),
n AS (SELECT row_id, i.topic, row_number() OVER (PARTITION BY i.topic ORDER BY row_id) + coalesce(serial, 0) AS n FROM incoming_questions i LEFT JOIN s ON s.topic = i.topic)
SELECT row_id, coalesce(topic, 'none') || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS new_id FROM n
""")
def renumber(spark: SparkSession, sf: str) -> DataFrame:
    serials = B.last_serials(table(spark, sf, "question_bank"), "topic", "id")
    incoming = table(spark, sf, "incoming_questions").select("row_id", "topic")
    return B.renumber(incoming, "topic", "row_id", serials, F.coalesce("topic", F.lit("none"))).select("row_id", "new_id")


@BANKS.add("free_ids", """
WITH u AS (SELECT DISTINCT id, 1 AS used FROM question_bank),
n AS (SELECT row_id, i.id, row_number() OVER (PARTITION BY i.id ORDER BY row_id) + coalesce(used, 0) AS n FROM incoming_questions i LEFT JOIN u ON u.id = i.id)
SELECT row_id, CASE WHEN n = 1 THEN id ELSE id || '-' || n END AS free_id FROM n
""")
def free_ids(spark: SparkSession, sf: str) -> DataFrame:
    return B.free_ids(table(spark, sf, "question_bank"), table(spark, sf, "incoming_questions").select("row_id", "id"), "id", "row_id").select("row_id", "free_id")


# Figures -------------------------------------------------------------------------

_CONTEXT = f"""
WITH o AS (SELECT entry_no, coalesce(module, '') AS module, title, summary, keywords, visual_signals.image_count AS images, list_filter(CASE WHEN {D.squeeze('summary')} = {D.squeeze('title')} THEN [{D.squeeze('title')}] ELSE [{D.squeeze('title')}, {D.squeeze('summary')}] END, lambda x: x <> '') AS own FROM kb_entries),
w AS (SELECT *, flatten(list(own) OVER (PARTITION BY module ORDER BY entry_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS near FROM o),
c AS (SELECT *, {D.in_order('near')}[1:8] AS context FROM w)
"""


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    title, summary = T.squeeze("title"), T.squeeze("summary")
    entries = table(spark, sf, "kb_entries").select("entry_no", F.coalesce("module", F.lit("")).alias("module"), "title", "summary", "keywords", F.col("visual_signals.image_count").alias("images"))
    own = F.filter(F.when(title == summary, F.array(title)).otherwise(F.array(title, summary)), lambda x: x != "")
    return S.context_lines(entries, "module", "entry_no", own)


@BANKS.add("context_window", _CONTEXT + "SELECT entry_no, array_to_string(context, chr(10)) AS context FROM c")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf).select("entry_no", F.array_join("context", "\n").alias("context"))


def _noise(x: str) -> str:
    s = D.squeeze(x)
    words = rf"list_filter(string_split({s}, ' '), lambda w: regexp_matches(w, '^[\x00-\x7f]+$'))"
    symbols = rf"length(regexp_replace({s}, '[^0-9=+\-*/×.%()\[\]]', '', 'g'))"
    return f"(CASE WHEN {s} = '' THEN 6.0 ELSE {D.flag(f'len({words}) >= 4 AND len(list_distinct({words})) <= 0.6 * len({words})')} * 7.0 + {D.flag(f'len({words}) > 0 AND {s} = lower({s}) AND NOT {D.has(s, f"[{T.CJK}]")}')} * 5.0 + {D.flag(f'{symbols} >= 0.18 * length({s})')} * 6.0 + {D.flag(D.has(s, '^[?？]'))} * 2.0 END)"


_TITLE_PENALTY = "(" + " + ".join(f"4.0 * {D.flag(f'contains(lower({D.squeeze("title")}), {D.lit(t)})')}" for t in I.GENERIC_TITLES) + f" + 1.5 * {D.flag(D.has(D.squeeze('title'), '^[?？]'))} + {D.flag(f'length({D.squeeze("title")}) <= 4')})"


@BANKS.add("figure_rank", _CONTEXT + f""",
f AS (SELECT entry_no, count(*) AS facts FROM kb_facts GROUP BY entry_no)
SELECT entry_no, images, round(images * 3.0 + coalesce(facts, 0) * 1.2 + coalesce(len(keywords), 0) * 0.5 + least(coalesce(list_sum(list_transform(context, lambda x: length(x))), 0), 220) / 55.0 - {_TITLE_PENALTY} - {_noise('title')} - {_noise('summary')}, 6) AS score,
 {D.flag(f"{D.squeeze('title')} <> '' AND NOT ({' OR '.join(f'contains(lower({D.squeeze("title")}), {D.lit(t)})' for t in I.GENERIC_TITLES)}) AND NOT (length({D.squeeze('title')}) <= 6 AND NOT {D.has(D.squeeze('title'), '[►(（]')}) AND {_noise('title')} < 8")} AS ready
FROM c LEFT JOIN f USING (entry_no) WHERE images > 0
""")
def figure_rank(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "kb_facts").groupBy("entry_no").agg(F.count(F.lit(1)).alias("facts"))
    made = _contexts(spark, sf).filter("images > 0").join(facts, "entry_no", "left")
    words = F.coalesce(F.size(F.coalesce("keywords", F.array().cast("array<string>"))), F.lit(0))
    score = I.candidate_score(F.col("images"), F.coalesce("facts", F.lit(0)), words, F.col("context"), "title", "summary")
    return made.select("entry_no", "images", F.round(score, 6).alias("score"), _flag(I.is_display_ready("title")).alias("ready"))
