import os

import duckdb
import pytest

import __spark_entry__ as entry
from sketchloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    for name, sql in catalog.oracle_sql().items():
        mine = catalog.queries()[name](spark, SF)
        cols = sorted(mine.columns)
        got = sorted(map(repr, (tuple(r[c] for c in cols) for r in mine.collect())))
        want = sorted(map(repr, con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql})").fetchall()))
        assert got == want, name


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
