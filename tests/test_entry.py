"""The entry works with and without the optional training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "repograin", tmp_path / "repograin", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    left = names(tmp_path)
    assert "change_counts" in left and not any(n.startswith("op") for n in left) and "pipeline" not in left
    assert left == {n for n in names(ROOT) if n != "pipeline" and not n.startswith("op")}
