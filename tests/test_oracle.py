"""Every SQL-backed registered query equals its DuckDB twin (sf0.001: fast; the driver checks sf0.01)."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from arrearscope.plans.catalog import load_all
from arrearscope.sources.tables import TABLES
from conftest import SF_SMALL

# the corpus operators have their own tests
QUERIES = {k: fn for k, fn in E.queries().items() if k in load_all()}
SQL = {k: sql for k, sql in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_query_has_a_check():
    missing = [k for k in QUERIES if k not in SQL]
    # rows-only keys: fitted models, random draws, approximate search, vectoriser output
    assert sorted(missing) == sorted(["thompson_pick", "train_forests", "train_gbt", "score_portfolio",
                                      "train_uplift", "uplift_score", "permutation_importance", "importance_order",
                                      "kmeans_segments", "model_io", "embed_chunks", "vector_topk_lsh",
                                      "vector_topk_ivf"])


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[key]).fetchdf()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
