"""The driver's gate: every registered query against its DuckDB oracle at sf0.01."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import SF01

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare  # noqa: E402
from parlance.registry import ORACLE_SQL, QUERIES  # noqa: E402


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF01, [name])[name]
    assert res["ok"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["line_id", "ts", "verb", "status", "reply"]
    assert df.count() == 1000


def test_entry_without_the_corpus_package(tmp_path):
    """The rest imports and lists its queries when the corpus operators are gone."""
    shutil.copytree(
        os.path.join(ROOT, "parlance"), tmp_path / "parlance",
        ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")],
    )
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    res = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert res.returncode == 0, res.stderr
    assert [x.split() for x in res.stdout.splitlines()] == [sorted(QUERIES)] * 2


def test_entry_with_a_corpus_package_that_cannot_be_imported(tmp_path):
    shutil.copytree(
        os.path.join(ROOT, "parlance"), tmp_path / "parlance",
        ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")],
    )
    (tmp_path / "parlance" / "llm").mkdir()
    (tmp_path / "parlance" / "llm" / "__init__.py").write_text("")
    (tmp_path / "parlance" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    res = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert res.returncode == 0 and res.stdout.split() == sorted(QUERIES)
    assert "a_module_that_is_not_there" in res.stderr
