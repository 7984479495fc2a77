"""Every registered query with SQL gives that SQL's rows."""

import os

import duckdb
import pytest

from nearfield.queries import oracle_sql, queries

DATA = os.environ.get("NEARFIELD_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "embeddings lineitem".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got, expected = queries()[name](spark, DATA).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, duck, name):
    assert queries()[name](spark, DATA).count() > 0


def test_entry_survives_without_subpackage(spark):
    import __spark_entry__

    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=Path(__file__).resolve().parent.parent)
