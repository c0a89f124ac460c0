"""Registered queries: names, SQL, and that the core stands alone."""

import pathlib
import re
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "keyword_topk" in entry.queries()


def test_the_core_does_not_import_the_optional_part():
    for path in (ROOT / "quillgrid").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quillgrid").parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text(encoding="utf-8")), path


def test_the_entry_stands_without_the_optional_part():
    code = "import sys\nsys.modules['quillgrid.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "place", "keyword", "score"] and out.count() > 0
