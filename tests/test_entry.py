"""The driver contract, with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_imports_without_text_operators(tmp_path):
    for name in ("pairforge", "__spark_entry__.py", "bench.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1') for n in q) and len(q) > 70; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "pairforge").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "pairforge").parts:
            assert "pairforge.llm" not in p.read_text()
