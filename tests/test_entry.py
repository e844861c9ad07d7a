"""The rest of the library without the training-data operations."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q), set(o) <= set(q))"


@pytest.mark.parametrize("gone", [("orrery/llm", "tests/llm"), ("orrery/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_them(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, pipeline, first, sql = said.stdout.split()
    left = (copy / "orrery/llm/queries.py").exists()
    assert int(n) > 50 and pipeline == "False" and first == str(left) and sql == "True"


def test_a_pipeline_elsewhere_on_the_path_is_not_taken(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (copy / "corpus_pipeline.py").unlink()
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False"


def test_nothing_else_imports_the_subpackage():
    for f in ROOT.rglob("*.py"):
        name = f.relative_to(ROOT).as_posix()
        if name.startswith(("orrery/llm/", "tests/llm/")) or name in ("corpus_pipeline.py", "__spark_entry__.py", "tests/test_entry.py"):
            continue
        assert "orrery.llm" not in f.read_text(), name
