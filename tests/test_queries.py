"""Every registered query of the library against its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from kinweave.plans import catalogue

from .compare import connect, differences

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    only_here, only_there, n = differences(spark, connect(sf_dir), catalogue.QUERIES[name], catalogue.ORACLES[name], sf_dir)
    assert not only_here and not only_there and n


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_rest_runs_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "kinweave"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "kinweave").mkdir()
    for part in (ROOT / "kinweave").iterdir():
        if part.name != "llm":
            (tmp_path / "kinweave" / part.name).symlink_to(part)
    code = f"import sys; sys.path[0] = {str(tmp_path)!r}; sys.path = [p for p in sys.path if p != {str(ROOT)!r}]; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert 'pipeline' not in e.queries()"
    code += "; from pyspark.sql import SparkSession as S; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.queries()['identity_prematch'](s, '/root/testdata/sf0.001').count() > 0"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=240)


def test_nothing_else_imports_the_corpus_operators():
    for source in (ROOT / "kinweave").rglob("*.py"):
        if "llm" not in source.parts:
            assert "kinweave.llm" not in source.read_text(), source
