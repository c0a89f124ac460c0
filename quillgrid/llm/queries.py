"""The pN_ queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Registry
from ..runtime import table
from .distinctive import most_characteristic, term_weights
from .history import repeats
from .leaks import leaked_documents
from .lookalike import canonical_form, look_alike_pairs
from .mix import mixture
from .neardup import near_duplicate_pairs
from .pairs import defective_pairs
from .spam import page_features, stuffed_pages

LLM = Registry()


def _core(text: str) -> str:
    return rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@LLM.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "kb_facts"), "fact_id", "question", table(spark, sf_dir, "question_bank"), "row_id", "prompt")


@LLM.add("p1_forms")
def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and prompt in its one form."""
    facts = table(spark, sf_dir, "kb_facts").select(F.lit("fact").alias("rec"), F.col("fact_id").alias("rec_id"), canonical_form("question").alias("form"))
    bank = table(spark, sf_dir, "question_bank").select(F.lit("bank").alias("rec"), F.col("row_id").alias("rec_id"), canonical_form("prompt").alias("form"))
    return facts.unionByName(bank)


_P2_SQL = rf"""
WITH c AS (SELECT row_id, {_core("coalesce(prompt, '') || ' ' || coalesce(analysis, '')")} AS core FROM question_bank),
g AS (SELECT DISTINCT row_id, substr(core, i, 4) AS g FROM c, unnest(generate_series(1, length(core) - 3)) AS t(i)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY 1, 2)
SELECT a AS row_id_a, b AS row_id_b FROM p JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE 10 * k >= 7 * (x.n + y.n - k)
"""


@LLM.add("p2_found", _P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "question_bank").select("row_id", "prompt", "analysis")
    whole = F.concat_ws(" ", F.coalesce("prompt", F.lit("")), F.coalesce("analysis", F.lit("")))
    return near_duplicate_pairs(bank, "row_id", whole, n=4, threshold=0.7)


_P3_SQL = rf"""
WITH r AS (
  SELECT row_id, 0 AS new, lower(trim(id)) AS id, {_core("coalesce(prompt, '')")} AS core FROM question_bank
  UNION ALL
  SELECT row_id, 1 AS new, lower(trim(id)) AS id, {_core("coalesce(prompt, '')")} AS core FROM incoming_questions),
g AS (SELECT DISTINCT row_id, new, substr(core, i, 3) AS g FROM r, unnest(generate_series(1, length(core) - 2)) AS t(i)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.new = 1 AND (b.new = 0 OR b.row_id < a.row_id) GROUP BY 1, 2)
SELECT a AS row_id FROM p JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE 10 * k >= 7 * (x.n + y.n - k)
UNION
SELECT a.row_id FROM r a JOIN r b ON a.id = b.id AND a.new = 1 AND a.id <> '' AND (b.new = 0 OR b.row_id < a.row_id)
"""


@LLM.add("p3_found", _P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(
        table(spark, sf_dir, "question_bank"), table(spark, sf_dir, "incoming_questions"), key="row_id", id_column="id", text="prompt", batch="batch_no", n=3, threshold=0.7
    )


@LLM.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "kb_facts").select(F.lit("fact").alias("rec"), F.col("fact_id").alias("rec_id"), "question", "answer", "type", F.lit(None).cast("array<struct<key:string,text:string>>").alias("options"))
    bank = table(spark, sf_dir, "question_bank").select(F.lit("bank").alias("rec"), F.col("row_id").alias("rec_id"), F.col("prompt").alias("question"), "answer", "type", "options")
    return defective_pairs(facts.unionByName(bank))


_P6_SQL = rf"""
WITH d AS (SELECT doc_id, {_core("text")} AS core FROM documents),
e AS (SELECT item_id, {_core("text")} AS core FROM eval_items),
w AS (SELECT DISTINCT item_id, substr(core, i, 80) AS g FROM e, unnest(generate_series(1, length(core) - 79)) AS t(i)),
v AS (SELECT DISTINCT doc_id, substr(core, i, 80) AS g FROM d, unnest(generate_series(1, length(core) - 79)) AS t(i))
SELECT DISTINCT doc_id, item_id FROM v JOIN w USING (g)
"""


@LLM.add("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaked_documents(docs, items, doc_id="doc_id", text="text", item_id="item_id", item_text="text", span=80)


_P4_USES = r"""
WITH k AS (
  SELECT entry_no, id, lower(coalesce(summary, '')) AS body, keywords,
         list_filter(list_transform(keywords, lambda t: regexp_replace(lower(t), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda t: t IS NOT NULL AND t <> '') AS ts
  FROM kb_entries),
u AS (
  SELECT entry_no, id, term, length(body) + length(array_to_string(ts, ' ')) AS len,
         len(list_filter(ts, lambda t: t = term)) + (length(body) - length(replace(body, term, ''))) // length(term) AS use
  FROM (SELECT entry_no, id, body, ts, unnest(list_distinct(ts)) AS term FROM k)),
f AS (SELECT term, count(DISTINCT id) AS df FROM u GROUP BY term),
n AS (SELECT count(DISTINCT id) AS n FROM u)
"""

_P4_SQL = (
    _P4_USES
    + """
SELECT entry_no, term FROM (
  SELECT entry_no, term, row_number() OVER (PARTITION BY entry_no ORDER BY round(use * ln(n / df), 6) DESC, term) AS place
  FROM u JOIN f USING (term), n WHERE df > 1) WHERE place = 1
"""
)


@LLM.add("p4_found", _P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = term_weights(table(spark, sf_dir, "kb_entries"), key="entry_no", record="id", terms="keywords", text="summary", k1=None, least_df=2)
    return most_characteristic(weights, "entry_no")


_P4_WEIGHTS_SQL = (
    _P4_USES
    + """,
a AS (SELECT avg(len) AS mean FROM (SELECT DISTINCT entry_no, len FROM u))
SELECT entry_no, term, use, df,
       round(ln(1 + (n - df + 0.5) / (df + 0.5)) * use * 2.2 / (use + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score
FROM u JOIN f USING (term), n, a
"""
)


@LLM.add("p4_weights", _P4_WEIGHTS_SQL)
def p4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturating, length-normalised weights of all terms."""
    return term_weights(table(spark, sf_dir, "kb_entries"), key="entry_no", record="id", terms="keywords", text="summary", k1=1.2, b=0.75)


@LLM.add("p7_mixture")
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mixture, with the source it stands for and its uses."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))[0]


@LLM.add("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every planned source."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))[1]


@LLM.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"), key="doc_id", text="text")


@LLM.add("p8_features")
def p8_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that pages are judged by."""
    return page_features(table(spark, sf_dir, "documents"), "doc_id", "text")
