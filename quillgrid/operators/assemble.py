"""Questions from facts: prompts, options, quality and selection.

Random choices are orders by md5 of a seed and the row's own names, so that any
engine and any partitioning makes the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import answer_signature, is_generic_prompt, signatures_fit
from ..functions.text import SPACE, col, is_low_information, squeeze
from .retrieve import top

FILLER = "不正确的备选项"
# What is cut off a question to get at its cue, in this order.
CUE_CLEANUPS = (
    "[？?]+$", "^下列哪项最能概括", "^下列哪一项最能概括", "^下列哪项", "^下列哪一项", "^关于[“\"]?", "[”\"]?，下列哪项表述正确$", "[”\"]?，下列哪个时间或数值是正确的$",
    "[”\"]?，下列哪一项术语或缩写是正确的$", "[”\"]?，下列哪项命令或参数写法是正确的$", "是哪一年加入", "由谁提出", "是什么$", "是指什么$", "哪种算法$", "哪一种序列比对策略$",
    "哪类噪声结构$", "哪一类任务$", "哪类信息$", "什么单位表示遗传距离$", "什么单位描述距离$", "什么环节$", "什么典型问题$", "什么核心搜索策略$", "什么典型价值$", "什么工具进行重复遮蔽$",
)


def seeded(seed: int, *parts: Column | str) -> Column:
    """The order of rows under a seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def adapted_prompt(question: Column | str, title: Column | str, answer: Column | str, exemplar: Column | None = None) -> Column:
    """A fact's own question if it says something, else one in the wording of an exemplar or of the answer's kind."""
    own, name, kind = squeeze(question), squeeze(title), answer_signature(answer)
    style = squeeze(F.lit("") if exemplar is None else exemplar)
    about = lambda tail: F.concat(F.lit("关于“"), name, F.lit(tail))
    return (
        F.when(~is_generic_prompt(own), own)
        .when(style.rlike("哪一年|何时|什么时候"), about("”，下列哪一年是正确的？"))
        .when(style.contains("最适合"), F.concat(F.lit("下列哪一项最适合描述“"), name, F.lit("”？")))
        .when(style.rlike("是什么|是指"), F.concat(F.lit("“"), name, F.lit("”是指什么？")))
        .when(kind == "numeric", about("”，下列哪个时间或数值是正确的？"))
        .when(kind == "acronym", about("”，下列哪一项术语或缩写是正确的？"))
        .when(kind == "command", about("”，下列哪项命令或参数写法是正确的？"))
        .otherwise(about("”，下列哪项表述正确？"))
    )


def cue_of(question: Column | str) -> Column:
    bare = reduce(lambda t, p: F.regexp_replace(t, p, ""), CUE_CLEANUPS, squeeze(question))
    return F.btrim(F.regexp_replace(bare, SPACE + "+", " "), F.lit("，,。:：;；“”\"' "))


def rewritten_prompt(question: Column | str, title: Column | str, answer: Column | str) -> Column:
    """Another wording for a prompt that the bank has already."""
    cue, name, kind = cue_of(question), squeeze(title), answer_signature(answer)
    within = lambda joint, tail: F.concat(F.lit("在“"), name, F.lit("”这一主题中，与“"), cue, F.lit(joint), F.lit(tail))
    round_ = lambda tail: F.concat(F.lit("围绕“"), name, F.lit(tail))
    cued = (cue != "") & (cue != name)
    return (
        F.when(cued & (kind == "numeric"), within("”相关的", "正确时间或数值是？"))
        .when(cued & (kind == "acronym"), within("”对应的", "术语或缩写是？"))
        .when(cued & (kind == "command"), within("”相关的", "正确工具或参数写法是？"))
        .when(cued, within("”直接相关的", "正确表述是？"))
        .when(kind == "numeric", round_("”，下列哪个时间或数值最合适？"))
        .when(kind == "acronym", round_("”，下列哪个术语或缩写最合适？"))
        .when(kind == "command", round_("”，下列哪项工具或参数写法最合适？"))
        .otherwise(round_("”，下列哪项说法最合适？"))
    )


def similar_entries(entries: DataFrame, key: str, module: str, terms: Column, asked: Column, k: int) -> DataFrame:
    """(key, place, other, score): the ``k`` entries most like each asked one.

    A shared module counts 3, each shared term 1.  Entries that share a term
    come from a join on terms.  Those that share only the module all score 3,
    so of them the first ``k + 1`` of each module are enough for the first k.
    """
    base = entries.select(F.col(key).alias("e"), F.col(module).alias("m"), terms.alias("ts"))
    asking = base.filter(asked)
    held = base.select(F.col("e").alias("other"), F.col("m").alias("m2"), F.explode(F.array_distinct("ts")).alias("term"))
    shared = asking.select("e", "m", F.explode(F.array_distinct("ts")).alias("term")).join(held, "term").filter(F.col("e") != F.col("other"))
    by_term = shared.groupBy("e", "other").agg((F.count(F.lit(1)) + F.when(F.max((F.col("m") == F.col("m2")) & (F.col("m") != "")), 3).otherwise(0)).alias("score"))
    first = top(base.filter("m <> ''").select("m", F.col("e").alias("other")), "m", [F.col("other")], k + 1).select("m", "other")
    by_module = asking.select("e", "m").join(first, "m").filter(F.col("e") != F.col("other")).select("e", "other", F.lit(3).cast("long").alias("score"))
    every = by_term.unionByName(by_module).groupBy("e", "other").agg(F.max("score").alias("score"))
    return top(every, "e", [F.desc("score"), F.col("other")], k).select(F.col("e").alias(key), "place", "other", "score")


def option_candidates(pool: Column, right: Column) -> Column:
    """Texts of a pool that can stand beside the right answer, in order."""
    kind = answer_signature(right)
    fit = lambda t: (t != "") & (t != squeeze(right)) & (F.length(t) <= 96) & ~is_low_information(t) & signatures_fit(kind, answer_signature(t))
    return F.filter(F.transform(F.coalesce(pool, F.array().cast("array<string>")), squeeze), fit)


def distractor_pool(matches: DataFrame, query: str, order: str, texts: str, most: int = 24) -> DataFrame:
    """(query, order, texts): matches in order until those before one have ``most`` texts; the one that reaches it counts whole."""
    before = F.coalesce(F.sum(F.size(texts)).over(Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return matches.withColumn("before", before).filter((F.col("before") < most) & (F.size(texts) > 0)).drop("before")


def options_of(right: Column | str, own: Column | str, pool: Column, seed: int, *names: Column | str) -> Column:
    """Four options A to D in seeded order: the answer, the fact's own distractors, then the pool's, then fillers.

    The fact's own distractors are taken as they are, even if equal to the
    answer or to each other; the pool's only once.
    """
    answer = squeeze(right)
    given = F.filter(F.transform(F.coalesce(col(own), F.array().cast("array<string>")), squeeze), lambda t: t != "")
    more = F.filter(F.array_distinct(pool), lambda t: (t != answer) & ~F.array_contains(given, t))
    some = F.slice(F.concat(given, more), 1, 3)
    filled = F.concat(some, F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i > F.size(some), F.concat(F.lit(FILLER), i.cast("string")))), lambda t: t.isNotNull()))
    ordered = F.array_sort(F.transform(F.concat(F.array(answer), filled), lambda t, i: F.struct(seeded(seed, *names, i, t).alias("o"), t.alias("text"))))
    return F.transform(ordered, lambda x, i: F.struct(F.substring(F.lit("ABCD"), i + 1, F.lit(1)).alias("key"), x["text"].alias("text")))


def key_of(options: Column, right: Column) -> Column:
    return F.element_at(F.filter(options, lambda o: o["text"] == squeeze(right)), 1)["key"]


def select_questions(candidates: DataFrame, prompt: str, rank: list[Column], good: Column, count: int, similarity: Column | None = None, defer: float = 96.0) -> DataFrame:
    """The first ``count`` candidates that are good, not too like the bank, and the first of their prompt.

    Acceptance depends on a row's own quality and on its prompt only, so the
    one-by-one choice is a ranking: one row a prompt, then the first ``count``.
    """
    kept = candidates.filter(good if similarity is None else good & (similarity < defer))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy(prompt).orderBy(*rank))).filter("_n = 1").drop("_n")
    return first.orderBy(*rank).limit(count)


def select_deferred(candidates: DataFrame, rewritten: str, rank: list[Column], good: Column, similarity: Column, again: Column, accepted: DataFrame, prompt: str, count: int, defer: float = 96.0, never: float = 99.5) -> DataFrame:
    """What was deferred, under its rewritten prompt: least alike first, new prompts only, up to ``count``."""
    late = candidates.filter(good & (similarity >= defer) & (again < never))
    late = late.join(accepted.select(F.col(prompt).alias(rewritten)).distinct(), rewritten, "left_anti")
    order = [similarity.asc(), *rank]
    first = late.withColumn("_n", F.row_number().over(Window.partitionBy(rewritten).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.orderBy(*order).limit(max(0, count))


def flattened_facts(entries: DataFrame, key: str, facts: DataFrame, entry: str, seed: int, count: int, *names: str) -> DataFrame:
    """``count`` facts of entries in seeded order."""
    return facts.join(entries.select(F.col(key).alias(entry)), entry, "left_semi").orderBy(seeded(seed, *names)).limit(count)


