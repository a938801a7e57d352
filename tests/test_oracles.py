"""Every registered query with SQL of its own gives DuckDB's rows at sf0.001."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAMILIES = ("a", "p", "c", "j", "r", "t", "io")
NAMES = sorted(k for k in entry._own() if entry._own()[k][1] and not k.endswith("_stream"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame: pd.DataFrame) -> list:
    def shown(x):
        if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
            x = x.tolist()
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float) or type(x).__name__ == "Decimal":
            x = round(float(x), 6)
            return f"{x:.6f}" if x != int(x) else str(int(x))
        return str(x)

    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
