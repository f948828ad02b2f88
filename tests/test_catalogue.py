"""Queries against their SQL over the smallest sample tables."""

import math
import os
import pathlib
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from tracewell.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name == "q03_duplicate_history_versions"
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_query_but_the_parser_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"q34b_page_data"}


def test_entry_imports_without_the_llm_parts(tmp_path):
    """In a copy without those parts all other queries are there; with them, theirs too; an error within them is told."""
    root = pathlib.Path(__file__).parents[1]
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') for q in e.queries()))"
    run = lambda at: subprocess.run([sys.executable, "-c", told], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True)
    whole = [root / p for p in ("__spark_entry__.py", "tracewell")] + [p for p in [root / "corpus_pipeline.py"] if p.exists()]
    for name, leave in (("without", ("llm", "corpus_pipeline.py")), ("whole", ())):
        at = tmp_path / name
        at.mkdir()
        for p in whole:
            if p.name not in leave:
                shutil.copytree(p, at / p.name, ignore=shutil.ignore_patterns("__pycache__", *leave)) if p.is_dir() else shutil.copy(p, at)
        out = run(at)
        n, n_sql, n_ops = map(int, out.stdout.split())
        assert (n >= len(catalogue.QUERIES) and n_sql >= len(catalogue.SQL)) and (n_ops == 0 or name == "whole")
    if (at / "tracewell/llm").exists():
        (at / "tracewell/llm/common.py").write_text("import no_such_module")
        assert "no_such_module" in run(at).stderr
