"""How characteristic a term is of its record.

Method
------
Probabilistic relevance weighting: inverse document frequency over the whole
collection times a term frequency that saturates (``k1``) and is normalised by
the record's length (``b``) against the collection's average.  ``k1=None`` is
its limit without saturation, the plain product of use and rarity.

Everything is built from Spark's own functions.  Document frequencies are
counted over distinct (record id, term), so a record that was extracted again
counts once, and a term of a third of all rows is aggregated before its shuffle.

Defined results
---------------
* null or blank terms, and null arrays, give no term; a null text counts as ''
* a null id counts for no document frequency, but its row is still scored
* repeated terms of a row add up; equal scores go to the term first in
  code-point order; an empty table gives no rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def term_uses(df: DataFrame, *, key: str, record: str, terms: str, text: str) -> DataFrame:
    """(key, record, term, use, len): use counts the row's terms and the text's occurrences."""
    plain = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.lower(t), _ENDS, ""))
    plain = F.filter(plain, lambda t: F.coalesce(F.length(t), F.lit(0)) > 0)
    body = F.lower(F.coalesce(text, F.lit("")))
    rows = df.select(F.col(key).alias("k"), F.col(record).alias("r"), plain.alias("ts"), body.alias("body"))
    rows = rows.withColumn("len", F.length("body") + F.length(F.concat_ws(" ", "ts")))
    one = rows.select("k", "r", "body", "len", "ts", F.explode(F.array_distinct("ts")).alias("term"))
    listed = F.size(F.filter("ts", lambda t: t == F.col("term")))
    written = (F.length("body") - F.length(F.replace(F.col("body"), F.col("term"), F.lit("")))) / F.length("term")
    return one.select("k", "r", "term", (listed + written).cast("long").alias("use"), "len")


def term_weights(df: DataFrame, *, key: str, record: str, terms: str, text: str, k1: float | None = 1.2, b: float = 0.75, least_df: int = 1) -> DataFrame:
    """(key, term, use, df, score) of every row's terms that occur in ``least_df`` records or more."""
    uses = term_uses(df, key=key, record=record, terms=terms, text=text)
    pairs = uses.select("r", "term").filter(F.col("r").isNotNull()).distinct()
    total = pairs.select("r").distinct().count()
    counts = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_df)
    scored = uses.join(counts, "term")
    if k1 is None:
        score = F.col("use") * F.log(F.lit(float(total)) / F.col("df"))
    else:
        average = uses.select("k", "len").distinct().agg(F.avg("len")).first()[0] or 1.0
        norm = F.lit(k1) * (1 - b + b * F.col("len") / average)
        score = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("use") * (k1 + 1) / (F.col("use") + norm)
    return scored.select(F.col("k").alias(key), "term", "use", "df", F.round(score, 6).alias("score"))


def most_characteristic(weights: DataFrame, key: str) -> DataFrame:
    """(key, term) of each row's highest score."""
    best = weights.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best"))
    return best.select(key, F.col("best.term").alias("term"))
