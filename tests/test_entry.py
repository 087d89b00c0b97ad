import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def cell(x):
    """Whole numbers exactly, others to nine digits, values of nested types one by one."""
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str, bytes)):
        return str(x)
    if isinstance(x, (float, Decimal)):
        return str(int(x)) if float(x).is_integer() else f"{float(x):.9g}"
    if isinstance(x, dict):
        return tuple(cell(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x.isoformat() if isinstance(x, (date, datetime)) else str(x)


def plain(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(row[k]) for k in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())
