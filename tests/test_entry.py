"""The registry, the flagship query, and a few SQL comparisons on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SAMPLE = ["bin_price_grid", "gradient_sobel_3x3", "opposite_by_direction", "score_lines", "resample_points",
          "transfer_once", "error_norms", "adaptive_stencil"]


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 130 and len(o) > 90


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.n_cells for r in rows) == 32000


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, D).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)

    for a, b in zip(rows_sorted(got, cols), rows_sorted(want, cols)):
        assert all((x is None and y is None) or (isinstance(x, str) and x == y) or math.isclose(x, y, abs_tol=1e-6)
                   for x, y in zip(a, b)), (a, b)


def rows_sorted(df, cols):
    out = [tuple(None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r)
           for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))
