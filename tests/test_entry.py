"""The driver's contract, with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80 and "zscore" in queries


def test_imports_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "gridspark", tmp_path / "gridspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'zscore' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_names_the_text_operators():
    for path in (ROOT / "gridspark").rglob("*.py"):
        assert "llm" in path.parts or "llm" not in path.read_text(), path
