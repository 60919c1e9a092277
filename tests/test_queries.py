"""The entry module: every query with SQL equals DuckDB on the smallest tables; streams; the guard."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from geosift.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def compare(spark, name, query, sql):
    import duckdb

    df = query(spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == columns, name
    want = [tuple(r[names.index(c)] for c in columns) for r in res.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key), name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["kind", "id", "refs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_grid_cells_cover_the_grid(spark):
    assert sum(r.n for r in queries.grid_cell_classes(spark, SF).collect()) == 4**7


def test_entry_imports_without_the_llm_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('geosift.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert 'cut_complete' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
