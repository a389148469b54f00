"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(root):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    rest = names(tmp_path / "r")
    assert "turn_pair_overlap" in rest and not any(n.startswith("op") and n[2].isdigit() for n in rest) and "pipeline" not in rest
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "r")
    (tmp_path / "r/sievemill/llm").mkdir()
    assert names(tmp_path / "r") == rest


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "sievemill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry_gives_rows(spark):
    import __spark_entry__

    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
