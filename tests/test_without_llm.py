"""The rest of the repository works without the llm folders and the pipeline."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry(tmp_path):
    shutil.copytree(REPO / "tabloom", tmp_path / "tabloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, m = map(int, got.stdout.split())
    assert n >= m > 20


def test_nothing_else_imports_llm():
    for p in (REPO / "tabloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"tabloom\.llm|from \.+llm", p.read_text()), p
