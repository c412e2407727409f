"""The driver's contract with and without the corpus part."""

import os
import shutil
import subprocess
import sys

import pytest

from varspan.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, check=True, timeout=120)
    return [line.split() for line in got.stdout.splitlines()[-2:]]


@pytest.mark.parametrize("gone", [["varspan/llm", "tests/llm"], ["varspan/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    queries, oracles = listed(copy)
    assert set(catalog.QUERIES) <= set(queries) and set(catalog.ORACLES) <= set(oracles) and "pipeline" not in queries
    assert any(q.startswith("op1_") for q in queries) == (copy / "varspan/llm").is_dir()
