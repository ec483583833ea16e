import ast
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_go_together():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 90


def test_flagship(spark):
    assert e.entry(spark).columns == ["chrom", "lo", "hi"]


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "spanloom").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "spanloom").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
