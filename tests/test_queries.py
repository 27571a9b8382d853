"""Every registered air-quality query against its DuckDB SQL."""

import duckdb
import pytest

from airq.queries import ORACLES, QUERIES

from .conftest import SMALL


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert normal(QUERIES[name](spark, SMALL).toPandas()).equals(normal(con.execute(ORACLES[name]).df()))
