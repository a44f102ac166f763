"""The driver's contract, and what holds when the subpackage llm is gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "revenue"] and df.count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_llm(tmp_path):
    for name in ("weftline", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'topk_revenue' in q, any(n.startswith('op1') or n == 'pipeline' for n in q))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert told.stdout.split()[1:] == ["True", "False"], told.stderr


def test_nothing_else_imports_llm():
    others = [p for p in (ROOT / "weftline").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if "weftline.llm" in p.read_text()]
