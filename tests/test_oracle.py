"""Every query that SQL can express gives DuckDB's rows, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandlake.plans.oracles import ORACLE_SQL
from strandlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
