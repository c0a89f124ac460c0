import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.operators import assemble as A
from quillgrid.operators import bank as B
from quillgrid.operators import browse as W
from quillgrid.operators import extract as X
from quillgrid.operators import figures as I
from quillgrid.operators import grading as G
from quillgrid.operators import pages as P
from quillgrid.operators import retrieve as R
from quillgrid.operators import segment as S


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro", "zero\n# One ►x\na\nb\n#\n# Two\n\n"), (2, "heads", "# A\n# B"), (3, None, None), (4, "plain", "only")], "d int, n string, t string")
    got = {(r.d, r.section): (r.title, r.module, r.body) for r in S.sections(docs, "d", "t", "n").collect()}
    assert got == {
        (1, 0): ("intro", "Imported Source", ["zero"]),
        (1, 1): ("One ►x", "One", ["a", "b"]),
        (2, 0): ("heads", "Imported Source", ["# A", "# B"]),
        (4, 0): ("plain", "Imported Source", ["only"]),
    }


def test_repeated_lines_and_clean_pages(spark):
    foot = "Course notes of the group, spring"
    pages = spark.createDataFrame([(1, p, f"{foot}\n- content of part {p}\nwx: 12\n• •\n• {foot}") for p in range(5)], "d int, p int, t string")
    many = S.repeated_lines(pages, "d", "p", "t")
    assert {(r.line, r.pages) for r in many.collect()} == {(foot, 5), (f"• {foot}", 5)}
    left = {r.line for r in S.clean_pages(pages, "d", "p", "t", many).collect()}
    assert left == {f"content of part {p}" for p in range(5)}


def merged(lines):
    out = []
    for x in (" ".join(t.split()).strip("•●▪■◆★·-–—:：;；|") for t in lines):
        if not x:
            continue
        if out and joins(out[-1].strip(), x.strip()):
            out[-1] = " ".join(f"{out[-1]} {x}".split())
        else:
            out.append(x)
    return out


def joins(a, b):
    import re

    if not a or not b:
        return False
    return bool(a.endswith(tuple("（(：:、/-→")) or b[0] in "）)、，,；;" or (len(a) < 18 and len(b) < 24 and not re.search("[。！？!?]$", a)) or re.match("[a-z0-9%/+-]", b))


def test_wrapped_lines_like_a_loop(spark):
    cases = [["短", "也短", "再短"], ["这一行已经足够长所以不会与下一行相连接了", "Next line begins", "and goes on"], ["开头（", "内容）", "，尾"], [], ["一句话。", "下一句"]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, x array<string>")
    got = [r[0] for r in df.orderBy("k").select(S.merge_wrapped("x")).collect()]
    assert got == [merged(c) for c in cases]


def test_titles_modules_and_fingerprints(spark):
    df = spark.createDataFrame([(1, 1, ["x" * 70, "第3讲 图谱", "第3讲 图谱"]), (1, 2, []), (1, 3, ["Part ► Sub", "b"]), (1, 4, ["内容概要"])], "d int, p int, x array<string>")
    titled = df.withColumn("t", S.pick_title("x", F.lit("stem")))
    assert [r.t for r in titled.orderBy("p").collect()] == ["第3讲 图谱", "stem", "Part ► Sub", "内容概要"]
    carried = S.carry_modules(titled, "d", "p", "t", F.lit("stem"))
    assert [r.module for r in carried.orderBy("p").collect()] == ["图谱", "图谱", "Part", "Part"]
    pages = spark.createDataFrame([(1, 1, "T", ["a b"], 1), (1, 2, "T", ["ab "], 5), (1, 3, "T", ["c"], 0)], "d int, p int, t string, b array<string>, i int")
    assert sorted((r.p, r.pages, r.images) for r in S.unique_pages(pages, "d", "p", "t", "b", F.col("i")).collect()) == [(1, [1, 2], 5), (3, [3], 0)]


def test_slides(spark):
    rows = [(1, ["  Title  here"], ["Title here", "这一行已经足够长所以不会与下一行相连接了", "N1"], ["N1", "补充的说明文字同样足够长所以也单独成行。"]), (2, [], ["第3讲 图谱"], [])]
    df = spark.createDataFrame(rows, "k int, t array<string>, b array<string>, n array<string>")
    title, body = S.slide_entry(F.col("t"), F.col("b"), F.col("n"), F.lit("stem"))
    got = {r.k: (r.title, r.body) for r in df.select("k", title.alias("title"), body.alias("body")).collect()}
    assert got[1][0] == "Title here" and got[1][1][-1].endswith("单独成行。") and "N1 " not in " ".join(got[1][1][:-1])
    assert got[2] == ("第3讲 图谱", [])


def test_entries_of_pages(spark):
    long = "这一行已经足够长所以不会与下一行相连接了，其值是第{}种。"
    foot = "生物信息学导论课程讲义第一部分目录页"
    pages = [("a_b", k, f"{foot}\n第{k}讲 图谱{k}\n" + long.format(k), None, k) for k in range(1, 5)]
    pages += [("a_b", 5, pages[0][2], None, 9), ("a_b", 6, " ", None, 0), ("a_b", 7, None, None, None), ("other", 1, "只有标题", "Layout title\n只有标题", 0), (None, 1, None, None, 0)]
    df = spark.createDataFrame(pages, "d string, p int, r string, l string, i int").withColumn("n", F.col("d"))
    got = {(r.d, r.p): r for r in P.page_entries(df, "d", "p", "r", "l", "i", "n").collect()}
    assert sorted(got, key=str) == [("a_b", 1), ("a_b", 2), ("a_b", 3), ("a_b", 4), ("other", 1)]
    one = got["a_b", 1]
    assert (one.title, one.module, one.pages, one.visual_signals.image_count, one.id[-6:]) == ("第1讲 图谱1", "图谱1", [1, 5], 9, "-p0001")
    assert one.summary == long.format(1) and len(one.facts) == 1 and foot not in str(got) and 0 < len(one.keywords) <= 8
    assert got["other", 1].title == "Layout title" and got["other", 1].module == "other"
    assert P.page_entries(df.limit(0), "d", "p", "r", "l", "i", "n").count() == 0


def test_entries_of_slides(spark):
    rows = [("deck", 1, ["A ► B"], ["第一块内容足够长所以不会与下一块内容相连接"], ["备注内容也足够长所以不会与上一块相连接了"], 2), ("deck", 2, [], ["第3讲 图谱"], None, 1), ("deck", 3, ["A ► B"], ["第一块内容足够长所以不会与下一块内容相连接"], ["备注内容也足够长所以不会与上一块相连接了"], 5), ("deck", 4, None, None, None, None)]
    df = spark.createDataFrame(rows, "d string, s int, t array<string>, b array<string>, n array<string>, i int").withColumn("name", F.col("d"))
    got = {r.s: r for r in P.slide_entries(df, "d", "s", "t", "b", "n", "i", "name").collect()}
    assert (got[1].module, got[1].pages, got[1].visual_signals.image_count, len(got[1].facts)) == ("A", [1, 3], 5, 2)
    assert got[2].title == got[2].summary == "第3讲 图谱" and got[2].module == "图谱" and got[2].id == "deck-s0002"
    assert set(got) == {1, 2, 4} and got[4].title == "deck slide 4" and got[4].module == "A"


def test_page_alignment_and_context(spark):
    texts = spark.createDataFrame([("f", 1, "a"), ("f", 2, " "), ("f", 3, "b")], "f string, p int, t string")
    counts = spark.createDataFrame([("f", 3)], "f string, n int")
    assert sorted((r.page, r.text) for r in S.align_pages(texts, "f", "p", "t", counts, "n").collect() if r.text) == [(1, "a"), (2, "b")]
    assert S.align_pages(texts, "f", "p", "t", counts, "n").count() == 3
    e = spark.createDataFrame([("g", k, [f"t{k}", "same"]) for k in range(3)], "g string, k int, own0 array<string>")
    assert S.context_lines(e, "g", "k", F.col("own0")).orderBy("k").first().context == ["t0", "same", "t1"]


def test_keyword_ties_and_weights(spark):
    df = spark.createDataFrame([(1, "Alpha", "beta gamma", "gamma beta delta"), (2, None, None, None)], "k int, a string, b string, c string")
    empty = lambda c: F.coalesce(c, F.lit(""))
    got = X.weighted_keywords(df, "k", [(empty("a"), 3), (empty("b"), 2), (empty("c"), 1)], 4)
    assert [(r.keyword, r.score) for r in got.orderBy("place").collect()] == [("Alpha", 3), ("beta", 3), ("gamma", 3), ("delta", 1)]


@pytest.mark.parametrize(
    "line, question, answer",
    [
        ("BLAST：比对工具。", "“BLAST”对应的内容是？", "比对工具"), ("外显子是编码区", "关于“外显子”，下列哪项表述正确？", "编码区"), ("基因组包括外显子", "“基因组”包括下列哪项内容？", "外显子"),
        ("长约 3.5 kb 左右", "根据知识库内容，下列哪个时间或数值是正确的？", "3.5 kb"), ("只有文字", "关于“题”，下列哪项表述与知识库一致？", "只有文字"),
        ("x：" + "长" * 81, "关于“题”，下列哪项表述与知识库一致？", "x：" + "长" * 81), ("我是人", "关于“题”，下列哪项表述与知识库一致？", "我是人"),
    ],
)
def test_facts(spark, line, question, answer):
    r = X.facts_of_lines(spark.createDataFrame([(1, line)], "k int, l string"), "k", "l", F.lit("题")).first()
    assert (r.question, r.answer) == (question, answer)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "d"), (3, "e")], "d int, term string")
    asked = spark.createDataFrame([(9, "b"), (9, "e"), (9, "zz")], "q int, term string")
    got = {r.d: r.bm25 for r in R.bm25(asked, "q", docs, "d").collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got == {d: round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / 2)), 9) for d, n in ((1, 2), (3, 3))}


@pytest.mark.parametrize("rare", [0.0, 0.1, 0.4, 1.0])
def test_the_best_are_those_of_all_scores(spark, rare):
    rng = np.random.default_rng(8)
    rows = {(d, f"t{int(t)}") for d in range(60) for t in np.minimum(rng.zipf(1.4, rng.integers(2, 12)), 40)}
    asked = {(q, f"t{int(t)}") for q in range(12) for t in np.minimum(rng.zipf(1.3, 4), 40)} | {(50, "none")}
    docs, queries = spark.createDataFrame(sorted(rows), "d int, term string"), spark.createDataFrame(sorted(asked), "q int, term string")
    order = [F.desc("bm25"), F.col("d")]
    want = R.top(R.bm25(queries, "q", docs, "d").withColumn("bm25", F.round("bm25", 6)), "q", order, 3).collect()
    got = R.top(R.Relevance(docs, "d").best(queries, "q", 3, rare).withColumn("bm25", F.round("bm25", 6)), "q", order, 3).collect()
    assert sorted((r.q, r.place, r.d, r.bm25) for r in got) == sorted((r.q, r.place, r.d, r.bm25) for r in want)


def test_normalisation_counts_what_no_term_found(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 3.0)], "q int, d int, s double")
    some = {(r.q, r.d): r.n for r in df.select("q", "d", R.normalised("s", "q", 5).alias("n")).collect()}
    every = {(r.q, r.d): r.n for r in df.filter("q = 1").select("q", "d", R.normalised("s", "q", 2).alias("n")).collect()}
    assert some == {(1, 1): 0.5, (1, 2): 1.0, (2, 1): 1.0} and every == {(1, 1): 0.0, (1, 2): 1.0}


def slow_rest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return len(a) + len(b) - 2 * row[-1]


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
@settings(max_examples=200)
def test_letters_to_change(a, b):
    assert R._rest(a, b) == slow_rest(a, b)


@given(st.text("abc 中", max_size=150), st.lists(st.text("abc 中", max_size=150), min_size=12, max_size=20))
@settings(max_examples=60)
def test_letters_to_change_of_many(a, others):
    assert R._rests(a, others).tolist() == [slow_rest(a, b) for b in others]


def test_token_set_ratio():
    assert R.token_set_ratio("a b", "b a c") == 100 and R.token_set_ratio("", "a") == 0 and R.token_set_ratio(None, "a") == 0
    assert R.token_set_ratio("abc", "abd") == pytest.approx(100 * (1 - 2 / 6))
    assert R.token_set_ratio("x same", "y same") == pytest.approx(100 * (1 - 2 / 12))


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(99, None)], "k int, v array<double>")
    got = R.nearest_vectors(df, "k", "v", F.col("k") % 7 == 0, 3, block=4).collect()
    for q in range(0, 60, 7):
        scores = v @ v[q]
        scores[q] = -2
        assert [r.other for r in sorted(got, key=lambda r: r.place) if r.query == q] == np.argsort(-scores)[:3].tolist()


def test_similar_entries(spark):
    rows = [(1, "m", ["a", "b"]), (2, "m", []), (3, "n", ["a", "b"]), (4, "", ["a"]), (5, "m", ["c"]), (6, "q", ["z"])]
    df = spark.createDataFrame(rows, "k int, m string, ts array<string>")
    got = A.similar_entries(df, "k", "m", F.col("ts"), F.col("e") == 1, 5)
    assert [(r.other, r.score) for r in got.orderBy("place").collect()] == [(2, 3), (5, 3), (3, 2), (4, 1)]


def test_options(spark):
    df = spark.createDataFrame([(1, "A1", ["B", " B ", "A1"], ["C"]), (2, "A1", None, ["A1", "C", "C", "D"]), (3, "A1", [], None)], "k int, a string, d array<string>, p array<string>")
    none = F.array().cast("array<string>")
    got = df.select("k", A.options_of("a", "d", F.coalesce("p", none), 7, "k").alias("o")).collect()
    texts = {r.k: sorted(x.text for x in r.o) for r in got}
    assert texts == {1: ["A1", "A1", "B", "B"], 2: sorted(["A1", "C", "D", "不正确的备选项3"]), 3: sorted(["A1", "不正确的备选项1", "不正确的备选项2", "不正确的备选项3"])}
    assert all([x.key for x in r.o] == list("ABCD") for r in got)


def greedy(rows, count):
    seen, out = set(), []
    for rank, prompt, good, sim, again, rewritten in sorted(rows):
        if len(out) < count and good and prompt not in seen and sim < 96:
            seen.add(prompt)
            out.append((rank, prompt))
    late = []
    for rank, prompt, good, sim, again, rewritten in sorted(rows, key=lambda r: (r[3], r[0])):
        if len(out) + len(late) < count and sim >= 96 and again < 99.5 and good and rewritten not in seen:
            seen.add(rewritten)
            late.append((rank, rewritten))
    return out, late


def test_selection_like_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"p{rng.integers(12)}", bool(rng.random() < 0.8), float(rng.choice([10, 95.9, 96, 99.5, 100])), float(rng.choice([50, 99.4, 99.5])), f"r{rng.integers(6)}") for k in range(40)]
    df = spark.createDataFrame(rows, "rank int, prompt string, good boolean, sim double, again double, rewritten string")
    for count in (3, 11, 30):
        first = A.select_questions(df, "prompt", [F.col("rank")], F.col("good"), count, F.col("sim"))
        n = first.count()
        late = A.select_deferred(df, "rewritten", [F.col("rank")], F.col("good"), F.col("sim"), F.col("again"), first, "prompt", count - n)
        want = greedy(rows, count)
        assert [(r["rank"], r.prompt) for r in first.orderBy("rank").collect()] == want[0]
        assert sorted((r["rank"], r.rewritten) for r in late.collect()) == sorted(want[1])


def test_distractor_pool_takes_whole_the_one_that_fills_it(spark):
    df = spark.createDataFrame([(1, k, ["x"] * 10) for k in range(5)] + [(2, 0, [])], "q int, o int, t array<string>")
    assert sorted(r.o for r in A.distractor_pool(df, "q", "o", "t").collect()) == [0, 1, 2]


def test_upsert_keeps_the_first_place_and_the_last_value(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y")], "n int, id string, v string")
    new = spark.createDataFrame([(1, "c", "z"), (2, "b", "z"), (3, "b", "w")], "n int, id string, v string")
    got = {r.id: (r.v, r.first_batch, r.first_order) for r in B.upsert(old, new, "id", "n").collect()}
    assert got == {"a": ("y", 0, 1), "b": ("w", 0, 2), "c": ("z", 1, 1)}


def test_serials_and_free_ids(spark):
    bank = spark.createDataFrame([("t", "x-007"), ("t", "x-1234"), ("u", None)], "g string, id string")
    new = spark.createDataFrame([("t", 1, "x-007"), ("t", 2, "n"), ("v", 3, "n")], "g string, o int, id string")
    ids = B.renumber(new, "g", "o", B.last_serials(bank, "g", "id"), F.col("g"))
    assert [r.new_id for r in ids.orderBy("o").collect()] == ["t-008", "t-009", "v-001"]
    assert [r.free_id for r in B.free_ids(bank, new, "id", "o").orderBy("o").collect()] == ["x-007-2", "n", "n-2"]


def test_filters(spark):
    f = W.Filters.of({"type": "short_answer", "search": "Ex On", "other": "x"})
    assert f.query() == {"type": "short_answer", "search": "Ex On"} and W.Filters().query() == {}
    df = spark.createDataFrame([(1, "short_answer", "EXON", None), (2, "short_answer", "x", ["exon"]), (3, "open", "exon", None), (4, "short_answer", None, None)], "k int, type string, prompt string, tags array<string>")
    for c in ("source", "topic", "answer", "analysis", "topic_name"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("knowledge_refs", F.lit(None).cast("array<string>")).withColumn("options", F.lit(None).cast("array<struct<key:string,text:string>>"))
    assert sorted(r.k for r in df.filter(f.condition()).collect()) == [1, 2]
    assert df.filter(W.Filters(module="m").condition()).count() == 0


def test_answers(spark):
    rows = [(1, "q", "A", "2024-01-02", "2024-01-02"), (2, "q", "B", "2024-01-03", "2024-01-03"), (3, "q", "C", None, "2024-01-09"), (4, "r", "A", "2024-01-01", "2024-01-01"), (5, "r", None, "2024-01-02", "2024-01-02"), (2, "q", "B", "2024-01-03", "2024-01-03"), (6, None, "A", None, None)]
    df = spark.createDataFrame(rows, "record_id int, question_id string, answer string, u string, r string")
    df = df.select("record_id", "question_id", "answer", F.lit(True).alias("checked"), F.lit(True).alias("correct"), F.to_timestamp("u").alias("updated_at"), F.to_timestamp("r").alias("received_at"))
    assert [(r.question_id, r.answer) for r in G.latest_answers(df).collect()] == [("q", "B")]
    marks = spark.createDataFrame([("multiple_choice", "ba", "AB"), ("multiple_choice", "ab", "BA"), ("single_choice", " a", "A"), ("short_answer", "long exon", "Exon"), ("short_answer", "", "x"), ("open_ended", "any", None), (None, "a", "ab")], "k string, g string, e string")
    assert [r[0] for r in marks.select(G.is_right("k", "g", "e")).collect()] == [True, False, True, True, False, True, True]


def test_figures(spark):
    df = spark.createDataFrame([("小结", ""), ("a a a a", "x"), ("Gene map 外显子", "它是图"), (None, None)], "t string, s string")
    assert [r[0] for r in df.select(I.title_penalty("t")).collect()] == [5.0, 0.0, 0.0, 1.0]
    assert [r[0] for r in df.select(I.noise_penalty("t")).collect()] == [0.0, 12.0, 0.0, 6.0]
    assert [r[0] for r in df.select(I.is_explainable("t", "s")).collect()] == [False, False, True, False]
    focus = I.summary_focus("t", "s", F.array(F.lit("外显子是编码区")))
    assert [r[0] for r in df.select(focus).collect()] == ["外显子是编码区", "x", "它是图", "外显子是编码区"]


def test_the_likest_texts_are_those_of_all_rows(spark):
    rng = np.random.default_rng(11)
    words = ["alpha", "beta", "gamma", "基因组装", "断裂点", "in", "of", "x1", "x2", "转座"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(120)] + ["基因组的断裂点与转座元件", "基因组中断裂点和转座子", "zq", None] + ["in of"] * 40
    rows = [(k, t, "ab"[k % 2]) for k, t in enumerate(texts)]
    asked = [(1, "基因组内断裂点与转座", "a"), (2, "alpha in gamma", "b"), (3, "of in x1", None), (4, "", "a")]
    bank = spark.createDataFrame(rows, "k int, t string, c string").repartition(3)
    queries = spark.createDataFrame(asked, "q int, a string, w string")
    got = R.likest_texts(bank, "k", "t", queries, "q", "a", 4, "c", "w", least=True, block=2).collect()
    for q, a, w in asked:
        every = {k: round(R.token_set_ratio(a, t) / 100, 6) for k, t, _ in rows}
        mine = {r.k: r.fuzzy for r in got if r.q == q}
        assert all(every[k] == f for k, f in mine.items())
        for same in (True, False):
            first = sorted((k for k, _, c in rows if (c == w) == same), key=lambda k: (-every[k], k))[:4]
            assert set(first) <= set(mine), (q, same)
        assert min(mine.values()) == min(every.values())


def normal(values):
    low, high = min(values), max(values)
    return [float(high > 0)] * len(values) if high - low < 1e-9 else [(v - low) / (high - low) for v in values]


@pytest.mark.parametrize("rows", [4, 70])
def test_fusion_like_a_loop_over_all_rows(spark, rows):
    rng = np.random.default_rng(rows)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    bank = [(k, list(dict.fromkeys(rng.choice(words[:6], rng.integers(0, 5)).tolist())), "".join(rng.choice(list("abc 中文"), rng.integers(0, 20))).strip(), "xy"[k % 2]) for k in range(rows)]
    asked = [(1, ["alpha", "beta"], "ab 中c文a", "x"), (2, ["eta"], "ca b文", "y"), (3, ["gamma", "zeta", "alpha"], "bb", None)]
    docs = spark.createDataFrame(bank, "k int, ts array<string>, t string, c string")
    queries = spark.createDataFrame(asked, "q int, ts array<string>, a string, w string")
    got = R.hybrid(docs.drop("ts"), "k", "t", "c", docs.select("k", "ts"), queries.drop("ts"), "q", "a", "w", queries.select("q", "ts"), 5).collect()
    grams = lambda ts: set(ts) | {f"{a} {b}" for a, b in zip(ts, ts[1:])}
    sized = [len(b[1]) for b in bank if b[1]]
    n, mean = len(sized), sum(sized) / len(sized)
    df = {w: sum(w in b[1] for b in bank) for w in words if any(w in b[1] for b in bank)}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    every = [grams(b[1]) for b in bank]
    weight = {g: math.log((1 + rows) / (1 + sum(g in e for e in every))) + 1 for e in every for g in e}
    norm = lambda gs: math.sqrt(sum(weight[g] ** 2 for g in gs))
    for q, ts, a, w in asked:
        own = {g for g in grams(ts) if g in weight}
        bm25 = [round(sum(idf[x] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(b[1]) / mean)) for x in ts if x in b[1]), 9) for b in bank]
        cosine = [round(sum(weight[g] ** 2 for g in own & e) / (norm(own) * norm(e)), 9) if own & e else 0.0 for e in every]
        fuzzy = [round(R.token_set_ratio(a, b[2]) / 100, 6) for b in bank]
        score = [0.45 * x + 0.35 * y + 0.20 * z + (0.08 if b[3] == w else 0) for x, y, z, b in zip(normal(bm25), normal(cosine), normal(fuzzy), bank)]
        want = sorted(range(rows), key=lambda k: (-round(score[k], 6), k))[:5]
        mine = sorted((r for r in got if r.q == q), key=lambda r: r.place)
        assert [r.k for r in mine] == want and [r.score for r in mine] == pytest.approx([score[k] for k in want], abs=2e-6)


@given(st.text("abc 中", max_size=90), st.lists(st.text("abc 中", max_size=90), min_size=12, max_size=16))
@settings(max_examples=60, deadline=None)
def test_many_ratios_are_those_of_one(a, others):
    assert R.token_set_ratios(a, others) == pytest.approx([R.token_set_ratio(a, b) for b in others])


def test_nearest_vectors_of_many_copies_are_the_first_ids(spark):
    rng = np.random.default_rng(4)
    ids = rng.permutation(600).tolist()
    df = spark.createDataFrame([(k, [1.0, 0.0] if k % 3 == 0 or k == 1 else [0.6, 0.8]) for k in ids], "k int, v array<double>").coalesce(1)
    got = R.nearest_vectors(df, "k", "v", F.col("k") == 1, 5).orderBy("place").collect()
    assert [(r.other, r.cosine) for r in got] == [(k, 1.0) for k in (0, 3, 6, 9, 12)]
