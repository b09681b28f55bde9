"""Registered queries next to their SQL, all of them at the smallest size."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from check import compare, connect
from conftest import SF

import __spark_entry__ as entry
from pagesift.plans.registry import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    line = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert line.startswith("ok"), line


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_without_the_training_data_operators(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], said.stderr


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query", "rank", "title", "url", "page_id", "score"] and frame.count() > 0
