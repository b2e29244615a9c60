"""The library stands without the subpackage for training data, and queries and SQL go together."""

import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent / "graphloom"


def test_nothing_outside_imports_the_llm_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("graphloom.llm") for n in names), path


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_queries_can_be_listed_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(), e.oracle_sql()"], cwd=ROOT.parent, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr
