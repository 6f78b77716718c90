"""Every registered query of the SQL side against its oracle SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from quillon import store_suite, suite

SF = "/root/testdata/sf0.001"
NAMES = [*suite.SUITE, *store_suite.QUERIES]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in suite.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted_rows(df.columns, df.collect())
    c = oracle.execute(__spark_entry__.oracle_sql()[name])
    assert got == sorted_rows([d[0] for d in c.description], c.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registered_names():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(NAMES) <= set(sql)


def test_without_the_corpus_operators(tmp_path):
    """The rest imports and registers where the corpus folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not any(n.startswith('op') for n in q), q.keys(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
