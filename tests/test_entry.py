"""The driver's entry, also without the training-data parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_training_data_parts(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    got = names(copy)
    assert "lab_by_segment" in got and "pipeline" not in got and not any(n.startswith("op") for n in got)
    assert set(got) <= set(names(ROOT))
