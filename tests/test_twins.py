"""Every registered query against its SQL twin, on whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from seekwell.plans.catalog import QUERIES

FOLDER = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    got = tidy(queries()[name](spark, FOLDER).toPandas())
    want = tidy(duck.sql(oracle_sql()[name]).df())
    assert len(want) > 0
    assert dict(got.dtypes) == dict(want.dtypes)
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())
