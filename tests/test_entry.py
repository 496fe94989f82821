"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__
from paragraf.plans import catalogue

DATA = "/root/testdata/sf0.001"
__spark_entry__.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    told = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert rows(df.columns, df.collect()) == rows(told.columns, told.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["paragraf.llm", "zstandard"])
def test_llm_is_optional(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'R1_bm25_filtered' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(__spark_entry__.__file__))
