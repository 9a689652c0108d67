import math
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from recordloom.plans import catalog

REPO, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if value is not None else None


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not Path(SF).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((plain(tuple(r[c] for c in order)) for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in order]
    assert got == sorted((plain(tuple(r[i] for i in place)) for r in want.fetchall()), key=repr)


def test_entry_works_without_the_corpus_operators(tmp_path):
    for name in ("recordloom", "__spark_entry__.py", "bench.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "recordloom" / "llm", ignore_errors=True)
    check = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True, timeout=120)


def test_entry_works_without_a_package_of_the_corpus_operators():
    check = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tag_pipeline' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", check], cwd=REPO, check=True, timeout=120)


def test_no_module_outside_imports_the_corpus_operators():
    for path in (REPO / "recordloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm import" not in path.read_text() and "import llm" not in path.read_text(), path
