"""Command line: inspect and extract sources, synthesize questions, merge banks, rank figures."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    from .sources.readers import build_knowledge_base

    entries = build_knowledge_base(spark, a.kb)
    entries.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("facts")).alias("facts")).show()
    entries.select("title").show(5, truncate=60)


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    from .sources.readers import build_knowledge_base
    from .sources.writers import write_lines

    write_lines(build_knowledge_base(spark, a.source), a.out)


def _synthesize(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators.assemble import adapted_prompt, key_of, options_of, seeded, select_questions
    from .functions.quality import is_usable_fact, quality_issues
    from .sources.readers import build_knowledge_base
    from .sources.writers import write_lines

    entries = build_knowledge_base(spark, a.kb)
    facts = entries.select("id", "title", F.posexplode("facts").alias("at", "f")).select("id", "title", "at", "f.*")
    usable = facts.filter(is_usable_fact("title", "answer"))
    own = F.col("distractors") if "distractors" in usable.columns else F.array().cast("array<string>")
    pool = usable.groupBy("title").agg(F.slice(F.array_sort(F.collect_set("answer")), 1, 24).alias("pool"))
    made = usable.join(pool, "title").withColumn("options", options_of("answer", own, F.col("pool"), a.seed, "id", "at"))
    made = made.withColumn("prompt", adapted_prompt("question", "title", "answer")).withColumn("key", key_of(F.col("options"), F.col("answer")))
    good = F.size(quality_issues("prompt", "explanation", "options", "key")) == 0
    rank = [seeded(a.seed, "id", "at"), F.col("id"), F.col("at")]
    chosen = select_questions(made.withColumn("good", good), "prompt", rank, F.col("good"), a.count)
    write_lines(chosen.select("id", "prompt", "options", F.col("key").alias("answer"), F.col("explanation").alias("analysis")), a.out)


def _merge(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators.bank import upsert
    from .sources.readers import read_bank
    from .sources.writers import write_lines

    write_lines(upsert(read_bank(spark, a.bank), read_bank(spark, a.incoming), "id", "position").drop("first_batch", "first_order"), a.out)


def _figures(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators.figures import candidate_score, is_explainable, meaning, summary_focus
    from .sources.readers import read_entries
    from .sources.writers import write_lines

    entries = read_entries(spark, a.kb).filter(F.col("visualSignals.imageCount") > 0).filter(is_explainable("title", "summary"))
    none = F.array().cast("array<string>")
    size = lambda c: F.size(F.coalesce(c, none))
    score = candidate_score(F.col("visualSignals.imageCount"), F.coalesce(F.size("facts"), F.lit(0)), size("keywords"), none, "title", "summary")
    focus = summary_focus("title", "summary", F.transform("facts", lambda f: f["answer"]))
    ranked = entries.select("id", "title", F.round(score, 6).alias("score"), focus.alias("summaryFocus"), meaning("title", focus).alias("meaning")).orderBy(F.desc("score"), "id")
    write_lines(ranked.limit(a.candidate_limit) if a.candidate_limit > 0 else ranked, a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgrid", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, run, options in (
        ("inspect", _inspect, {"kb": None}),
        ("extract", _extract, {"source": None, "out": None}),
        ("synthesize", _synthesize, {"kb": None, "out": None, "count": 12, "seed": 7}),
        ("merge", _merge, {"bank": None, "incoming": None, "out": None}),
        ("extract-figures", _figures, {"kb": None, "out": None, "candidate-limit": 24}),
    ):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for option, default in options.items():
            p.add_argument(f"--{option}", required=default is None, default=default, type=int if isinstance(default, int) else str)
    return top


def main(argv: list[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    arguments.run(_session(), arguments)


if __name__ == "__main__":
    main()
