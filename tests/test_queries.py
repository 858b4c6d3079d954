"""Every query that has SQL against that SQL in DuckDB; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype.kind in "iufb":
            frame[c] = frame[c].astype(float).round(5) + 0.0
        else:
            frame[c] = frame[c].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, atol=2e-5)
    spark.catalog.clearCache()


#: Several panels each; `test_panel` covers what they are made of.
SLOW = {"meta_bootstrap", "permutation_baseline", "panel_with_categories", "poisson_panel"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()
