"""Every registered query against its comparison SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.registered import ORACLE, QUERIES

# Queries that are empty on the smallest tables only.
MAY_BE_EMPTY = {"sources_by_region", "select_sources_region", "zero_result_sources"}


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_small, con, name):
    sql = ORACLE[name]
    state, rows = compare(spark, sf_small, QUERIES[name], sql, con)
    assert state == "ok" or (state == "no rows" and name in MAY_BE_EMPTY), state


def test_every_query_is_listed():
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLE.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "periodico", "titulo", "fecha", "texto", "url", "terminos_encontrado", "departamento",
    ]
    assert df.count() > 0


def test_the_rest_runs_without_the_training_data_folders(tmp_path):
    """On a copy without ``noticiario/llm``, with and without the pipeline beside it."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    leave = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json")
    shutil.copytree(root, copy, ignore=leave)
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    for pipeline in (True, False):
        if not pipeline and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-B", "-c", told], cwd=copy, capture_output=True, text=True, check=True)
        assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE)), "False"]
