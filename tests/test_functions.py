import pytest
from pyspark.sql import functions as F

from quillgrid.functions import quality as Q
from quillgrid.functions import rules as U
from quillgrid.functions import text as T


def values(spark, texts, make):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("t"))).collect()]


def test_spaces_and_bullets(spark):
    assert values(spark, [" a　b \n", None, "​"], T.squeeze) == ["a b", "", "​"]
    assert values(spark, ["- foo"], T.clean_line) == [" foo"]
    assert values(spark, ["a b　c"], T.search_key) == ["abc"]


def test_slugs(spark):
    assert values(spark, [" Gene Map-2 组装! ", "!!", None], T.slug) == ["gene-map-2-组装", "entry", "entry"]
    assert values(spark, ["A_b é"], lambda t: T.slug(t, "word")) == ["a_b"]
    assert values(spark, ["A_b é"], lambda t: T.slug(t, "unicode", "item")) == ["a_b-é"]


def test_line_predicates(spark):
    assert values(spark, ["Email: x", "hotel", "plain"], T.is_contact) == [True, True, False]
    assert values(spark, ["Page 3 / 9", "All Rights Reserved", "未经同意不得转载", "homepage 3x", "页 12"], T.is_footer) == [True, True, True, False, True]
    assert values(spark, ["•—", "• a"], T.is_bullets) == [True, False]


def test_lines_break_where_text_does(spark):
    assert values(spark, ["a\r\nb\x0bc d\n", None], T.lines) == [["a", "b", "c", "d", ""], [""]]


def test_tokens(spark):
    assert values(spark, ["DNA the 基因组 组装 x"], T.keyword_tokens) == [["DNA", "基因", "因组", "基因组", "组装"]]
    assert values(spark, ["一二三四五六七八九十百"], T.keyword_tokens) == [["一二", "二三", "三四", "四五", "五六", "六七", "七八", "八九", "九十", "十百"]]
    assert values(spark, ["DNA dna 组装 组装 一二三四五六七八九十百千万", ""], T.search_tokens) == [["dna", "组装"], []]


def test_html(spark):
    page = "<p>a&nbsp;&lt;b&gt;c</p><script>x</p></script>\n\n\n\n<STYLE>y</STYLE>d &amp;lt;"
    assert values(spark, [page], T.html_text) == [" a\u00a0 c  \n\n d &lt;"]


def test_small_helpers(spark):
    assert values(spark, ["./a/b.png", "https://x", "/r"], lambda t: T.relative_path(t, "base/")) == ["base/a/b.png", "https://x", "/r"]
    assert [tuple(x) for x in values(spark, ["B. two ", "none", ""], T.parse_option)] == [("B", "two"), ("", "none"), ("", "")]
    assert values(spark, ["<a & 'b'>"], T.escape_html) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert values(spark, ["x" * 30 + "KEY" + "y" * 60, "zz"], lambda t: T.snippet(t, "key")) == ["x" * 10 + "KEY" + "y" * 37, "zz"]


@pytest.mark.parametrize(
    "text, kind",
    [("2003年", "numeric"), ("12.5 kb", "numeric"), ("a/b", "command"), ("run.py", "command"), ("BLAST", "acronym"), ("基因组", "short_cjk"), ("一" * 13, "short_phrase"), ("x" * 32, "short_phrase"), ("x" * 33, "sentence"), ("", "short_phrase")],
)
def test_signatures(spark, text, kind):
    assert values(spark, [text], Q.answer_signature) == [kind]


def test_focus_and_options(spark):
    assert values(spark, ["关于“外显子”，下列哪项表述正确？", "“格式”对应的内容是？", "别的"], Q.prompt_focus) == ["外显子", "格式", ""]
    assert values(spark, ["格式", "第3讲", "外显子", ""], Q.is_noisy_focus) == [True, True, False, True]
    assert values(spark, ["#", "a", "ok", "x�y", None], Q.is_bad_option) == [True, True, False, True, True]
    assert values(spark, ["@tag_x", "标签", "a b", "12"], Q.surface_bucket) == ["identifier", "cjk-token", "phrase", "numeric"]


def issues(spark, prompt, analysis="说明文字。", options=(("A", "外显子"), ("B", "内含子"), ("C", "启动子"), ("D", "终止子")), answer="A"):
    df = spark.createDataFrame([(prompt, analysis, list(options) if options is not None else None, answer)], "p string, n string, o array<struct<key:string,text:string>>, a string")
    return df.select(Q.quality_issues("p", "n", "o", "a")).first()[0]


@pytest.mark.parametrize(
    "case, code",
    [
        ({"prompt": "太短"}, "prompt-too-short"), ({"prompt": "下列哪一项是正确的�"}, "ocr-noise"), ({"prompt": "关于“回顾上一讲”，下列哪项表述正确？"}, "noisy-focus"),
        ({"prompt": "下列哪项命令或参数写法正确？"}, "prompt-answer-mismatch-command"), ({"prompt": "下列哪个时间或数值正确？"}, "prompt-answer-mismatch-numeric"),
        ({"prompt": "下列哪一项术语或缩写正确？", "options": [("A", "12 kb"), ("B", "13 kb"), ("C", "1 kb"), ("D", "2 kb")]}, "prompt-answer-mismatch-acronym"),
        ({"prompt": "“格式”对应的内容是？"}, "mapping-fragment"), ({"prompt": "下列哪一项是正确的？", "options": [("A", "外显子"), ("B", "#"), ("C", "启动子"), ("D", "终止子")]}, "bad-option"),
        ({"prompt": "下列哪一项是正确的？", "options": [("A", "外显子"), ("B", "12"), ("C", "13"), ("D", "终止子")]}, "option-signature-mismatch"),
        ({"prompt": "关于“标签字段名”，下列哪项表述正确？", "options": [("A", "外显子"), ("B", "内含子"), ("C", "启动子"), ("D", "Cap site x")]}, "attribute-option-mismatch"),
        ({"prompt": "下列哪一项是正确的？", "analysis": "http://x"}, "low-information-analysis"),
    ],
)
def test_quality_codes(spark, case, code):
    assert code in issues(spark, **case)


def test_a_clean_question_and_one_of_nulls(spark):
    assert issues(spark, "下列哪一项是正确的说法？") == []
    assert issues(spark, None, None, None, None) == ["prompt-too-short"]


def test_usable_facts(spark):
    df = spark.createDataFrame([("基因组 组装", "组装 基因组"), ("基因组", "x" * 96), ("基因组", "x" * 97), ("基因组", "Email: a"), ("基因组", None), (None, "外显子")], "t string, a string")
    assert [r[0] for r in df.select(Q.is_usable_fact("t", "a")).collect()] == [False, True, False, False, False, True]


def test_rules(spark):
    df = spark.createDataFrame([("[多选] 测序图", [("A", "x"), ("B", "y")], "AB"), ("别的", [("A", "x")], "C"), ("概率", None, "文字"), (None, [("A", "x"), ("B", "y"), ("C", "z")], "B")], "p string, o array<struct<key:string,text:string>>, a string")
    kind = U.type_of("a", "p", "o")
    got = df.select(U.topic_of("p"), kind, U.difficulty_of("p", kind, F.lit(True), F.size(F.coalesce("o", F.array().cast("array<struct<key:string,text:string>>"))))).collect()
    assert [tuple(r) for r in got] == [("sequencing-methods", "multiple_choice", 5), ("general", "short_answer", 5), ("general", "open_ended", 5), ("general", "single_choice", 3)]
    tags = df.select(U.tags_of("p", F.lit("BLAST"), F.lit("t"), kind, F.lit(False))).first()[0]
    assert tags == ["alignment", "multi-select", "multiple_choice", "sequencing", "t"]
