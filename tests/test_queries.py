"""Every registered core query runs on the smallest tables and equals its SQL where it has some."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

FOLDER = os.environ.get("TESSERA_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, FOLDER).count() > 0


def test_every_statement_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_rest_imports_without_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("tessera", "."):
        for path in glob.glob(f"{root}/{folder}/**/*.py", recursive=True):
            if "/llm/" not in path and not path.endswith("__spark_entry__.py") and "/tests/" not in path:
                assert "tessera.llm" not in open(path).read(), path
