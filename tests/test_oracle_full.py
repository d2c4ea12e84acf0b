"""Every registered query against its oracle SQL at sf0.01 (the correctness
gate); `python tools/check_oracle.py` runs the same comparison from the shell."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from tools.check_oracle import TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_ORACLE}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_oracle(spark, duck, key):
    s_cols, s_rows = rows_of(E.queries()[key](spark, SF_ORACLE).toPandas())
    o_cols, o_rows = rows_of(duck.sql(E.oracle_sql()[key]).df())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows
