import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgrid import cli
from quillgrid.sources import readers as S
from quillgrid.sources import writers as K
from quillgrid.streaming import answers as V


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PA = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def slide(*shapes, pics=0):
    made = "".join(f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{k}{chr(34)}/>" if k else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>' for k, t in shapes)
    return f"<p:sld {PA}>{made}{'<p:pic/>' * pics}</p:sld>"


def test_text_html_and_unknown(spark, tmp_path):
    (tmp_path / "notes.md").write_text("# One\na\nb\n", encoding="utf-8")
    (tmp_path / "page.html").write_text("<h1>x</h1>&amp;", encoding="utf-8")
    r = S.read_documents(spark, str(tmp_path / "notes.md")).first()
    assert (r["name"], r.suffix, r.text) == ("notes", ".md", "# One\na\nb\n")
    assert S.read_documents(spark, str(tmp_path / "page.html")).first().text == " x &"
    with pytest.raises(ValueError):
        S.read_documents(spark, "a.xyz")


def test_docx_and_pptx(spark, tmp_path):
    doc = f"<w:document {W}><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": doc}))
    assert S.read_documents(spark, str(tmp_path / "a.docx")).first().text == "one two\nthree"
    files = {"ppt/slides/slide10.xml": slide((None, "late")), "ppt/slides/slide2.xml": slide(("title", "T"), ("body", "b"), pics=2), "ppt/notesSlides/notesSlide2.xml": slide((None, "n"))}
    (tmp_path / "a.pptx").write_bytes(archive(files))
    got = [(r.slide, r.titles, r.body, r.notes, r.images) for r in S.read_slides(spark, str(tmp_path / "a.pptx")).orderBy("slide").collect()]
    assert got == [(2, ["T"], ["b"], ["n"], 2), (10, [], ["late"], [], 0)]
    assert S.read_documents(spark, str(tmp_path / "a.pptx")).first().text.split("\n\n")[1].strip() == "late"


def test_pages_and_slides_become_entries(spark, tmp_path):
    raw = "第1讲 图谱\n这一行已经足够长所以不会与下一行相连接了\f \f第二页的标题\n另外一行也足够长所以不会与下一行相连接了\f多出来的一页内容"
    listing = "page num type width\n---- --- ---- -----\n1 0 image 10\n1 1 smask 10\n2 2 image 10"
    df = spark.createDataFrame([("/x/lec_1.pdf", raw, raw, "Title: t\nPages: 2", listing), ("/x/b.pdf", "one page\f", "", None, None)], "file string, layout string, raw string, info string, listing string")
    pages = {(r.name, r.page): (r.raw, r.images) for r in S.pages_of(df).collect()}
    assert set(pages) == {("lec_1", 1), ("lec_1", 2), ("b", 1)} and pages["lec_1", 2][0].startswith("第二页") and pages["lec_1", 1][1] == pages["lec_1", 2][1] == 1
    files = {"ppt/slides/slide1.xml": slide(("title", "A ► B"), ("body", "第一块内容足够长所以不会与下一块内容相连接"), pics=2)}
    (tmp_path / "deck.pptx").write_bytes(archive(files))
    (only,) = S.build_knowledge_base(spark, str(tmp_path / "deck.pptx")).collect()
    assert (only.title, only.module, only.id, only.pages, only.visual_signals.image_count) == ("A ► B", "A", "deck-s0001", [1], 2)


def test_json_bases_banks_answers_and_figures(spark, tmp_path):
    entry = {"id": "e", "title": "t", "keywords": ["k"], "facts": [{"question": "q", "answer": "a"}]}
    (tmp_path / "kb.json").write_text(json.dumps({"meta": {}, "entries": [entry]}), encoding="utf-8")
    (tmp_path / "list.json").write_text(json.dumps([entry, entry]), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{}", encoding="utf-8")
    assert S.build_knowledge_base(spark, str(tmp_path / "kb.json")).first().facts[0].answer == "a"
    assert S.read_entries(spark, str(tmp_path / "list.json")).count() == 2
    with pytest.raises(Exception, match="no list"):
        S.read_entries(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "bank.json").write_text(json.dumps({"questions": [{"id": "1", "options": [{"key": "A", "text": "x"}]}]}), encoding="utf-8")
    assert S.read_bank(spark, str(tmp_path / "bank.json")).first().options[0].text == "x"
    (tmp_path / "answers.json").write_text(json.dumps({"1": {"answer": "A", "pdf_page": "12"}, "2": {"answer": "", "pdf_page": "x"}}), encoding="utf-8")
    assert sorted((r.id, r.answer, r.pdf_page) for r in S.read_answers(spark, str(tmp_path / "answers.json")).collect()) == [("1", "A", 12), ("2", "", None)]
    figures = spark.createDataFrame([("f1", "T", 2.5)], "id string, title string, score double")
    K.write_document(figures, str(tmp_path / "figures"), "figures", {"made": "here"}, order="id")
    assert S.read_figures(spark, str(tmp_path / "figures")).first().title == "T"


def test_page_helpers(spark):
    df = spark.createDataFrame([("f", "a\fb", "x\fy\fz", "Title: one: two\nPages: 3\nPages: 4", "page num type\n---\n1 0 image\n1 1 smask\n2 0 image\n2 1 image\nx")], "f string, l string, r string, i string, c string")
    assert [(r.page, r.layout, r.raw) for r in S.split_pages(df, "f", "l", "r").orderBy("page").collect()] == [(1, "a", "x"), (2, "b", "y"), (3, None, "z")]
    assert df.select(S.document_info(F.col("i"))).first()[0] == {"Title": "one: two", "Pages": "4"}
    assert sorted((r.page, r.images) for r in S.image_census(df, "f", "c").collect()) == [(1, 1), (2, 2)]


def test_legacy_arrays(spark, tmp_path):
    (tmp_path / "old.html").write_text("<script>const Q = [ {id: 'a', q: 'see http://x', opts: ['A. \"1\"',], imgSrc: 'i'}, // note\n ];</script>", encoding="utf-8")
    r = S.read_legacy(spark, str(tmp_path / "old.html"), {"Q": 2022, "NONE": 2023}).collect()
    assert [(x.id, x.q, x.opts, x.image, x.year, x.source) for x in r] == [("a", "see http://x", ['A. "1"'], "i", 2022, "2022")]


def test_tables_are_replaced_elsewhere(spark, tmp_path):
    old, new = str(tmp_path / "a"), str(tmp_path / "b")
    K.write_table(spark.range(5), old)
    assert spark.read.parquet(K.replace_table(spark.read.parquet(old).filter("id > 2"), old, new)).count() == 2
    with pytest.raises(ValueError):
        K.replace_table(spark.range(1), old, old + "/")
    K.clear(new, spark.range(1))
    assert spark.read.parquet(new).count() == 0


def test_the_stream_keeps_what_batches_would(spark, tmp_path):
    rows = [(1, "q", "A", "2024-01-02"), (2, "q", None, "2024-01-03"), (3, "q", "C", "2024-01-01"), (4, "r", "A", "2024-01-01")]
    df = spark.createDataFrame(rows, "record_id long, question_id string, answer string, u string").select("record_id", "question_id", "answer", F.to_timestamp("u").alias("updated_at"), F.to_timestamp("u").alias("received_at"))
    out = (tmp_path / "out").as_uri()
    for part in ([1, 4], [2], [3, 1]):
        df.filter(F.col("record_id").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        V.keep_answers(stream, out, str(tmp_path / "check")).awaitTermination()
    got = {r.question_id: r.answer for r in V.current(spark, out).collect()}
    assert got == {"q": None, "r": "A"} and V.current(spark, str(tmp_path / "none")) is None


def test_the_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    text = "\n".join(f"{'甲乙丙丁戊己庚辛'[k]}组分{'子丑寅卯辰巳午未'[k]}是第{'一二三四五六七八'[k]}种常见的调控元件类型" for k in range(8))
    (tmp_path / "notes.md").write_text(f"# 基因组调控\n{text}\n", encoding="utf-8")
    cli.main(["inspect", "--kb", str(tmp_path / "notes.md")])
    cli.main(["extract", "--source", str(tmp_path / "notes.md"), "--out", str(tmp_path / "kb")])
    assert spark.read.json(str(tmp_path / "kb")).first().title == "基因组调控"
    cli.main(["synthesize", "--kb", str(tmp_path / "notes.md"), "--out", str(tmp_path / "made"), "--count", "3"])
    made = spark.read.json(str(tmp_path / "made")).collect()
    assert 0 < len(made) <= 3 and all(r.answer in "ABCD" and len(r.options) == 4 for r in made)
