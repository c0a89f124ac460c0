"""Best rows by shared terms: all queries against all rows, held against scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgrid.functions import text as T
from quillgrid.operators import retrieve as R
from quillgrid.operators import toplists as L

SMALLEST = entry.SMALLEST


def _made(spark, words=60, docs=300, queries=40, seed=3):
    draw = random.Random(seed)
    names = [f"w{x}" for x in range(words)]
    text = lambda n: " ".join(draw.choices(names, [1 / (1 + x) for x in range(words)], k=n))
    held = [(k, text(draw.randint(1, 30)), draw.choice("ab")) for k in range(docs)] + [(docs, None, "a"), (docs + 1, "", None)]
    asked = [(k, text(draw.randint(1, 20)), draw.choice("ab")) for k in range(queries)] + [(queries, None, "a"), (queries + 1, "nowhere", "b")]
    return spark.createDataFrame(held, "d long, t string, kind string"), spark.createDataFrame(asked, "q long, t string, wanted string")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _same(got, want):
    got, want = _rows(got), _rows(want)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)  # all pairs are rounded twice


def test_terms_are_those_of_the_column_function(spark):
    texts = ["Gfn5-λ 与断裂点　的 GTF/A. b", "一二三四五六七八九十一二三 ab AB ab", "", None, "x y\tzz q+1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.search_tokens("t").alias("ts"), R.with_pairs(T.search_tokens("t")).alias("ps"))
    for r in df.collect():
        assert L.terms(r.t) == r.ts and L.terms(r.t, pairs=True) == list(dict.fromkeys(r.ps))


@pytest.mark.parametrize("words, chunk", [(60, 50), (60, 10_000), (4, 50)])
def test_best_relevance_is_that_of_all_pairs(spark, monkeypatch, words, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    held, asked = _made(spark, words)
    of = lambda df, key: R.terms_of(df.select(key, T.search_tokens("t").alias("ts")), key, F.col("ts"))
    every = R.bm25(of(asked, "q"), "q", of(held, "d"), "d").withColumn("bm25", F.round("bm25", 6))
    want = R.top(every, "q", [F.desc("bm25"), F.col("d")], 5).select("q", "place", "d", "bm25")
    _same(L.TermIndex(held, "d", "t", asked, "q", "t").best_relevance(5), want)


@pytest.mark.parametrize("words, chunk", [(60, 50), (4, 10_000)])
def test_best_cosine_is_that_of_all_pairs(spark, monkeypatch, words, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    held, asked = _made(spark, words)
    of = lambda df, key: R.terms_of(df.select(key, T.search_tokens("t").alias("ts")), key, R.with_pairs(F.col("ts")))
    every = R.tfidf(of(asked, "q"), "q", of(held, "d"), "d", held.count()).withColumn("tfidf", F.round("tfidf", 6))
    want = R.top(every, "q", [F.desc("tfidf"), F.col("d")], 5).select("q", "place", "d", "tfidf")
    _same(L.TermIndex(held, "d", "t", asked, "q", "t", pairs=True).best_cosine(5, held.count()), want)


@pytest.mark.parametrize("words, chunk", [(60, 50), (60, 10_000), (4, 50), (2, 50)])
def test_best_lexical_is_that_of_all_pairs(spark, monkeypatch, words, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    held, asked = _made(spark, words)
    of = lambda df, key: R.terms_of(df.select(key, T.search_tokens("t").alias("ts")), key, F.col("ts"))
    total = of(held, "d").select("d").distinct().count()  # as in the SQL, rows without terms do not count
    every = R.bm25(of(asked, "q"), "q", of(held, "d"), "d").join(held, "d").join(asked.select("q", "wanted"), "q")
    every = R.fused(every, "q", {"bm25": 0.45}, total, F.when(F.col("kind") == F.col("wanted"), 0.08).otherwise(0.0))
    want = R.top(every, "q", [F.desc("score"), F.col("d")], 5).select("q", "place", "d", "score")
    _same(L.TermIndex(held, "d", "t", asked, "q", "t", kind="kind", wanted="wanted").best_lexical(5), want)


@pytest.mark.parametrize("name", ["lexical_rank", "hybrid_rank"])
def test_no_pairs_are_joined(spark, name):
    plan = entry.queries()[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_no_rows_and_no_queries(spark):
    held, asked = _made(spark)
    assert L.TermIndex(held.limit(0), "d", "t", asked, "q", "t").best_relevance(5).count() == 0
    assert L.TermIndex(held, "d", "t", asked.limit(0), "q", "t").best_relevance(5).count() == 0


@pytest.mark.parametrize("name", ["bm25_topk", "tfidf_topk"])
def test_every_fact_is_asked(spark, name):
    assert "% 50" not in entry.oracle_sql()[name]
    asked = {r.fact_id for r in entry.queries()[name](spark, SMALLEST).select("fact_id").distinct().collect()}
    assert len(asked) > spark.read.parquet(f"{SMALLEST}/kb_facts.parquet").count() * 0.9


def test_every_fact_is_ranked(spark):
    facts = spark.read.parquet(f"{SMALLEST}/kb_facts.parquet").count()
    assert entry.queries()["hybrid_rank"](spark, SMALLEST).select("fact_id").distinct().count() == facts
