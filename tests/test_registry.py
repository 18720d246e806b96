"""The registry without the training-data operators, as a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_the_subpackage(tmp_path):
    (tmp_path / "tallyfold").mkdir()
    for f in (ROOT / "tallyfold").rglob("*.py"):
        to = tmp_path / f.relative_to(ROOT)
        if "llm" not in f.relative_to(ROOT).parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(f, to)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    queries, sql, extra = said.stdout.strip().split(" ", 2)
    assert int(queries) >= int(sql) > 50 and extra == "[]"


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "tallyfold").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(encoding="utf-8")
