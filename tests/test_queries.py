"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from criterium.plans.catalog import ORACLE_SQL, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            return int(v) if v.is_integer() else round(v, 6)
        if type(v).__name__.startswith(("int", "uint")):
            return int(v)
        return str(v)

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))


def matches(spark, data, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    matches(spark, data, QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark).collect()
    assert len(found) == 3 and all(0 <= r["pass_rate"] <= 100 and not math.isnan(r["pass_rate"]) for r in found)
