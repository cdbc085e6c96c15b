"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    got = e.entry(spark)
    assert got.columns == ["post_id", "n", "rank", "tier", "views", "views_velocity", "views_acceleration", "lifecycle"] and got.count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split(" ", 1)[1].strip() == "[]" and int(said.stdout.split()[0]) > 90
