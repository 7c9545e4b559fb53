import glob
import os

import duckdb
import pandas as pd
import pytest

from quirefold.plans import archive, composed, finding, index, reports, values  # noqa: F401 - they register their queries
from quirefold.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def rows(df):
    cell = lambda x: None if pd.isna(x) else float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(([cell(x) for x in r] for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.sql(SQL[name]).df())
