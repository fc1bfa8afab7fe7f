"""The corpus operators are optional: the rest works without them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "pairlens", tmp_path / "pairlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kgram_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_them():
    for path in (ROOT / "pairlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "pairlens.llm" not in path.read_text()
