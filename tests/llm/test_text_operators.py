"""Look-alikes, term weights, leaks, defects, mixtures and stuffed pages on small tables."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillgrid.llm.distinctive import most_characteristic, term_weights
from quillgrid.llm.leaks import Items, leaked_documents, leaks_exact
from quillgrid.llm.lookalike import canonical, canonical_form, look_alike_pairs
from quillgrid.llm.mix import Flow, mixture, route, shares
from quillgrid.llm.pairs import PLACEHOLDERS, declines, defective_pairs, is_copy, is_truncated, opening
from quillgrid.llm.spam import features, stuffed_pages

form = canonical().of


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢ１，？", "AB1,?"), ("é", "é"), ("a​b﻿", "ab"), ("x y", "x y"), (" x　", "x"), ("Аpple", "Apple"), ("⼦列", "子列"), ("ﬁn", "fin"), ("a​́", "á"), ("x‑y－z", "x-y-z"), ("ё", "ë"), ("Å", "Å"), ("가", "가"), ("ｶﾞ", "ガ")],
)
def test_equal_to_the_eye(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [("é", "e"), ("①", "1"), ("²", "2"), ("A", "a"), ("β", "b"), ("γ", "y"), ("x y", "xy"), ("。", "."), ("最", "")])
def test_different_to_the_eye(a, b):
    assert form(a) != form(b)


@given(st.text(max_size=40))
def test_a_form_is_its_own_form(text):
    assert form(form(text)) == form(text)


@given(st.text(alphabet="abcXYZ012 ,.中文", max_size=40))
def test_plain_text_is_left_alone(text):
    assert form(text) == text.strip(" ")


def test_look_alike_pairs_with_nulls_blanks_and_repeats(spark):
    a = spark.createDataFrame([(1, "ＡＢＣ", "x"), (2, None, "x"), (3, "​", "x"), (4, "abc", "x"), (5, "ＡＢＣ", "x"), (6, "长" * 50000 + "，", "x")], "f long, q string, own string")
    b = spark.createDataFrame([(10, "ABC", "x"), (11, "ＡＢＣ", "x"), (12, " ", "x"), (13, None, "x"), (14, "长" * 50000 + ",", "x")], "r long, p string, h1 string")
    got = {tuple(x) for x in look_alike_pairs(a, "f", "q", b, "r", "p").collect()}
    assert got == {(1, 10), (5, 10), (6, 14)}
    assert look_alike_pairs(a.limit(0), "f", "q", b, "r", "p").count() == 0
    assert [x[0] for x in b.select(canonical_form("p")).collect()][3] is None


def test_term_weights(spark):
    rows = [
        (1, "e1", [" DNA", "dna", "Rare "], "DNA and dnadna", 0),
        (2, "e1", ["DNA", "other", ""], None, 0),
        (3, "e2", ["dna", None, "other"], "", 0),
        (4, "e3", None, "dna", 0),
        (5, "e4", [], "", 0),
        (6, "e5", ["b", "a"], "", 0),
        (7, "e6", ["a", "b"], "", 0),
        (8, None, ["a"], "a", 0),
    ]
    df = spark.createDataFrame(rows, "n long, id string, kw array<string>, s string, term int")
    got = {(r.n, r.term): (r.use, r.df, r.score) for r in term_weights(df, key="n", record="id", terms="kw", text="s", k1=None, least_df=2).collect()}
    assert got[1, "dna"] == (5, 2, round(5 * math.log(4 / 2), 6)) and (1, "rare") not in got
    assert got[8, "a"] == (2, 2, round(2 * math.log(2), 6))
    best = {tuple(r) for r in most_characteristic(term_weights(df, key="n", record="id", terms="kw", text="s", k1=None, least_df=2), "n").collect()}
    assert (6, "a") in best and (7, "a") in best and not {4, 5} & {k for k, _ in best}
    bm25 = term_weights(df, key="n", record="id", terms="kw", text="s").collect()
    assert all(r.score > 0 for r in bm25) and len(bm25) > len(got)
    assert term_weights(df.limit(0), key="n", record="id", terms="kw", text="s").count() == 0


def test_leaks_are_those_of_the_definition(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdef 文字，.") for _ in range(n))
    items = [(k, word(300)) for k in range(8)] + [(8, None), (9, "short"), (10, "a" * 200), (11, "ab" * 100)]
    docs = []
    for k in range(60):
        i = rng.randrange(8)
        at, size = rng.randrange(150), rng.randrange(40, 150)
        docs.append((k, word(rng.randrange(200)) + items[i][1][at : at + size].upper() + word(rng.randrange(200)), 0))
    docs += [(60, None, 0), (61, "", 0), (62, "a" * 3000, 0), (63, "x" + "ba" * 60, 0), (64, word(20000) + items[3][1] + word(20000), 0), (65, items[0][1], 0)]
    want = {(d, i) for d, t, _ in docs for i, u in items if leaks_exact(t, u, 40)}
    a = spark.createDataFrame(docs, "d long, t string, h long")
    b = spark.createDataFrame(items, "i long, u string")
    for bound in (10**6, 0):
        out = leaked_documents(a, b, doc_id="d", text="t", item_id="i", item_text="u", span=40, broadcast_chars=bound)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leaked_documents(a, b.limit(0), doc_id="d", text="t", item_id="i", item_text="u").count() == 0


@given(st.text("ab", min_size=0, max_size=120), st.text("ab", min_size=0, max_size=120), st.integers(3, 30))
def test_winnowing_misses_no_run(doc, item, span):
    assert bool(Items([item], span).leaks([doc])) == leaks_exact(doc, item, span)


Q = "考察样本的覆盖曲线与内含子的关系，应如何验证？"
CASES = [
    (None, "empty"), ("", "empty"), ("　", "empty"), ("N/A", "empty"), ("（略）", "empty"), ("——", "empty"),
    ("抱歉，我无法回答与ABC12有关的问题。", "refusal"), ("I'm sorry, but I can't help with XY12.", "refusal"),
    ("答：" + Q, "copy"), (f"“{Q}”", "copy"), ("考察样本的覆盖曲线与内含子的关系 应如何验证", "copy"),
    ("此外，样本在窗口内呈周期性分布，尤其当", "truncated"), ("从结果看，第9号支架上的", "truncated"), ("这与旧结果相反；（2）", "truncated"), ("课程组重做的清单需要逐条核对，即“", "truncated"),
    ("Der Abschnitt muss nach dem Lauf noch einmal geprüft werden, weil die Abdeckung zu gering ist.", "language"), ("이 구간은 다시 정렬한 뒤 비교해야 합니다.", "language"),
    ("AGP", None), ("双峰覆盖", None), ("12.5%", None), (Q + "：样本需要逐条核对。", None), ("样本需要逐条核对。（见图9）", None), ("读段过短时没有可用的信息。", None), ("这与旧结果约为 3.2。", None),
]


def test_defects(spark):
    rows = [("t", k, Q if k % 2 == 0 or kind != "refusal" else Q, a, None, "x") for k, (a, kind) in enumerate(CASES)]
    # Refusals are templates: they recur across unrelated prompts.
    rows += [("u", 0, "完全不同的另一个提问是什么？", "抱歉，我无法回答与QQ99有关的问题。", "open_ended", "x"), ("u", 1, "An unrelated question about trees, is it?", "I'm sorry, but I can't help with ZZ77.", "open_ended", "x")]
    rows += [("c", 0, Q, "B", "single_choice", "x"), ("c", 1, Q, "待定", "multiple_choice", "x"), ("c", 2, Q, Q, "single_choice", "x"), ("n", 0, None, "样本需要逐条核对。", None, "x"), ("n", 1, None, None, None, "x")]
    df = spark.createDataFrame(rows, "rec string, rec_id long, question string, answer string, type string, label string")
    got = {(r.rec, r.rec_id): r.defect for r in defective_pairs(df).collect()}
    assert {k: got.get(("t", k)) for k in range(len(CASES))} == {k: kind for k, (_, kind) in enumerate(CASES)}
    assert got["u", 0] == got["u", 1] == "refusal" and got["c", 1] == "empty" and got["n", 1] == "empty"
    assert not {("c", 0), ("c", 2), ("n", 0)} & set(got)
    assert defective_pairs(df.limit(0)).count() == 0


TOPICS = "内含子 外显子 启动子 终止密码子 增强子 微卫星 假基因 转座元件 单倍型块 甲基化岛".split()
PROMPTS = [f"{a}样本的覆盖曲线与{b}的关系，应如何验证第{k}号记录？" for k, (a, b) in enumerate((a, b) for a in TOPICS for b in TOPICS if a != b)]
#: Wordings and languages that no list of the code has.
HELD_OUT = {
    "refusal": ["Barkatu, ezin diot galdera honi erantzun", "Vabandust, ma ei oska sellele vastata.", "这方面鄙人才疏学浅，容后再议吧。"],
    "empty": ["尚在整理", "［筹备中］", "hamarosan"],
}


def test_wordings_that_no_list_has(spark):
    assert not any(declines(a) for a in HELD_OUT["refusal"]) and not any(a.strip("［］") in PLACEHOLDERS for a in HELD_OUT["empty"])
    rows, want = [], {}
    for k, q in enumerate(PROMPTS):
        a = f"{TOPICS[k % 10]}的边界要按第{k}号记录重新确定。"
        if k % 10 == 3:
            kind = ("refusal", "empty")[k // 10 % 2]
            a = HELD_OUT[kind][k // 20 % 3]
            want[k] = kind
        rows.append(("t", k, q, a, "open_ended", None))
    # Each held-out wording recurs; sound answers recur as well.
    for k, (kind, a) in enumerate((kind, a) for kind in HELD_OUT for a in HELD_OUT[kind]):
        for j in range(4):
            rows.append(("r", 10 * k + j, PROMPTS[(17 * k + 5 * j) % len(PROMPTS)], a, None, None))
            want["r", 10 * k + j] = kind
    for j in range(6):
        rows.append(("s", j, PROMPTS[7 * j], ("启动子丢失", "Ab12Cd未收录", "读段过短时没有可用的样本记录。", "AGP", "MX-12的覆盖曲线无法判断外显子，须补测。", "12.5%")[j], None, None))
        rows.append(("s", 10 + j, PROMPTS[7 * j + 1], ("启动子丢失", "Ab13Cd未收录", "读段过短时没有可用的样本记录。", "AGP", "MX-14的覆盖曲线无法判断外显子，须补测。", "12.5%")[j], None, None))
    options = [("A", "启动子"), ("B", "增强子")]
    rows += [("c", 0, PROMPTS[0], "A", "single_choice", options), ("c", 1, PROMPTS[1], "答案马上来", "single_choice", options), ("c", 2, PROMPTS[2], "增强子", "single_choice", options)]
    rows += [("c", 3, PROMPTS[3], PROMPTS[3], "single_choice", None), ("c", 4, PROMPTS[4], "答案马上来", "open_ended", None)]
    df = spark.createDataFrame(rows, "rec string, rec_id long, question string, answer string, type string, options array<struct<key string, text string>>")
    got = {(r.rec, r.rec_id): r.defect for r in defective_pairs(df).collect()}
    assert {k: got.get(("t", k)) for k in range(len(PROMPTS)) if k in want or ("t", k) in got} == {k: v for k, v in want.items() if isinstance(k, int)}
    assert {k: got.get(k) for k in want if not isinstance(k, int)} == {k: v for k, v in want.items() if not isinstance(k, int)}
    assert not [k for k in got if k[0] == "s"]
    assert {k: v for k, v in got.items() if k[0] == "c"} == {("c", 1): "empty", ("c", 3): "copy", ("c", 4): "empty"}


LANGUAGES = [
    "Odcinek trzeba jeszcze raz sprawdzić, ponieważ pokrycie jest zbyt małe.", "Bölüm yeniden kontrol edilmelidir çünkü kapsama derinliği çok düşük kalıyor.", "يجب فحص هذا المقطع مرة أخرى لأن عمق القراءة منخفض جدا.",
    "ต้องตรวจสอบส่วนนี้อีกครั้งเพราะความลึกต่ำเกินไป", "इस खंड की फिर से जाँच करनी होगी क्योंकि गहराई बहुत कम है।", "Το τμήμα πρέπει να ελεγχθεί ξανά επειδή το βάθος είναι πολύ μικρό.", "Het gedeelte moet opnieuw worden nagekeken omdat de dekking te laag blijft.", "Avsnittet måste kontrolleras igen eftersom täckningen är alldeles för låg.",
]


@pytest.mark.parametrize("english", [False, True])
def test_languages_that_no_list_has(spark, english):
    plain = [f"How would you verify the {a} of the coverage curve when the {b} of record {k} is short?" for k, (a, b) in enumerate(zip("intron exon promoter enhancer insulator pseudogene inversion breakpoint".split(), "window border draft sample library marker cluster profile".split(), strict=True))]
    asked = plain if english else PROMPTS[:8]
    sound = [f"The coverage of the {w} in record {k} is short, so the window and the border of the sample have to be verified." if english else f"{w}的覆盖曲线在记录{k}里没有变化。" for k, w in enumerate("intron exon promoter enhancer insulator pseudogene inversion breakpoint".split())]
    rows = [("f", k, asked[k], a, None) for k, a in enumerate(LANGUAGES)] + [("s", k, asked[k], a, None) for k, a in enumerate(sound)] + [("p", k, q, "AGP", None) for k, q in enumerate(asked * 3)]
    got = {(r.rec, r.rec_id): r.defect for r in defective_pairs(spark.createDataFrame(rows, "rec string, rec_id long, question string, answer string, type string")).collect()}
    assert got == {("f", k): "language" for k in range(len(LANGUAGES))}


def test_copies_with_labels_and_without_characters():
    q = "How should the window of record 12 be verified when the sample is short"
    assert all(is_copy(q, a) for a in (q, "Question: " + q + "?", "The question was as follows: " + q, q.upper(), q.replace("of record 12", "of record 1"), q + " " + q, q + " (see above)", f"[{q}]"))
    assert not any(is_copy(q, a) for a in (q + ": the border moves.", "AGP", "the window", q + ": AGP and BED", "short")) and not is_copy("", "x")
    assert opening("抱歉，AB12不行。然后") == "抱歉，#不行。"


def test_a_bare_term_is_no_truncation():
    assert not is_truncated("the open reading frame of Pag81") and is_truncated("The training set follows the heavy-tailed signal of Mhp67 in most runs, whi")
    assert not is_truncated("x" * 5 + "。") and is_truncated("长" * 100000)


def test_flow_fills_first_and_repeats_least():
    plan = {"a": (0.5, 3), "b": (0.5, 1)}
    got = route({("a",): 10, ("a", "b"): 40, ("b",): 30}, plan, 100)
    assert sum(n for (_, s), n in got.items() if s == "a") == 50
    assert sum(n for (_, s), n in got.items() if s == "b") == 50
    f = Flow(4)
    cheap, dear = f.add(0, 1, 5, 1), f.add(0, 2, 5, 3)
    f.add(1, 3, 4), f.add(2, 3, 9)
    f.run(0, 3)
    assert (f.room[cheap ^ 1], f.room[dear ^ 1]) == (4, 5)


def test_repetition_stays_dearer_the_more_there_is_of_it():
    # Both patterns can serve "a"; past the eighth use the one used less is taken.
    got = route({("a",): 1, ("a", "b"): 1}, {"a": (1.0, 1000), "b": (0.0, 1)}, 64)
    assert got[("a",), "a"] == got[("a", "b"), "a"] == 32


def test_shares_of_a_plan():
    got = shares([("a", 0.5, 2), ("b", None, None), ("c", 0.3, 0), (None, 0.2, 1), ("a", 0.4, 1)])
    assert got["a"] == (0.5, 1) and math.isclose(sum(s for s, _ in got.values()), 1) and math.isclose(got["b"][0], 0.2) and got["c"][1] == 0


def test_mixture(spark):
    docs = [(k, "big", f"text number {k} of the big source") for k in range(300)] + [(1000 + k, "small", f"small text {k}") for k in range(10)]
    docs += [(2000, "other", "no plan"), (2001, "big", None), (2002, None, "orphan"), (2003, "small", "text number 5 of the big source"), (2004, "small", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    p = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 4), ("gone", 0.1, None)], "source string, target_share double, max_repeat int")
    mixed, report = mixture(d, p)
    rows, by = mixed.collect(), {r.source: r for r in report.collect()}
    assert max(r.uses for r in rows if r.source == "small") == 4 and by["gone"].reached == 0
    assert abs(by["big"].reached - by["big"].quota) <= 10 and by["small"].reached <= 4 * by["small"].available
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixture(d, p)[0].collect()}
    assert mixture(d.limit(0), p)[0].count() == 0 and mixture(d, p.limit(0))[0].count() == 0


SPAM = [
    "assay kit plasmid prep assay kit exam dump plasmid prep assay kit exam dump assay kit plasmid prep " * 4,
    "\n".join(f"[kit](https://a.example/x/{k})" for k in range(20)),
    "标签: 试剂盒; 芯片; 试剂盒; 质粒; 芯片; 试剂盒\n品牌: 芯片; 试剂盒; 质粒; 芯片\n型号: 试剂盒; 芯片; 质粒; 试剂盒",
    "分析服务是分析服务，分析服务就选离心管。离心管是分析服务，离心管就选分析服务。" * 8,
]
PROSE = [
    "样本的覆盖曲线在窗口内呈周期性分布，与旧结果相反。 https://a.example/x/1 课程组重做的清单需要逐条核对。",
    "Csk75\t819\t20%\tAGP\nWgz22\t161\t1.4%\tFASTA\nSGN75\t5\t11%\tVCF\nXwh64\t946\t2%\tBED",
    "cmd --in a.gtf --window 40 --out b\ncmd --in c.gtf --window 41 --out d\ncmd --in e.gtf --window 42 --out f",
    ">NH-71740\nATCTACGAGCATATGCATATAGTGTTAGCGGGAAACGAAAGG",
    "The alignment has to be checked by the group, and the records can be used at once.",
]


_RNG = random.Random(9)
LONG = " ".join(f"The {a} {b} of {c} {d} is {e}." for a, b, c, d, e in (["".join(_RNG.choices("abcdefghijklmnop", k=8)) for _ in range(5)] for _ in range(9000)))


def test_stuffed_pages(spark):
    rows = [(k, t, 0.1) for k, t in enumerate(SPAM)] + [(100 + k, t, 0.1) for k, t in enumerate(PROSE * 3)] + [(200, None, 0.0), (201, " ", 0.0), (202, LONG, 0.0), (203, SPAM[1] * 500, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stuffing double")
    got = [r[0] for r in stuffed_pages(df, key="doc_id", text="text").collect()]
    assert sorted(got) == [0, 1, 2, 3, 203]
    assert stuffed_pages(df.limit(0), key="doc_id", text="text").count() == 0
    assert features("")[0] == "latin"
