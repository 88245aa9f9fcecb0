"""The entry module, with and without the llm subpackage, and oracles on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"


def test_entry_without_llm():
    hide = "import sys; sys.modules['aeonframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", hide], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no small tables")
def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    from aeonframe.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")

    def plain(v):
        return round(v + 0.0, 5) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    for name in sorted(ORACLE_SQL):
        df = QUERIES[name](spark, FOLDER)
        columns = sorted(df.columns)
        found = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns, name
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want, name
