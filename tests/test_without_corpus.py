"""The package works, and the entry module imports, when the corpus operators are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "slidespark", tmp_path / "slidespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'positive_pixel_count' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    for p in (ROOT / "slidespark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "slidespark.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
