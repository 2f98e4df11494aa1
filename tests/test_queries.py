"""Every query against its SQL in DuckDB on the same tables, and rows of those without one."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tilewright.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got, want = tidy(QUERIES[name](spark, sf_dir).toPandas()), tidy(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_numeric_dtype(want[c]):
            pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_exact=True)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 12
    assert all(60 <= r["mean"] <= 190 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
