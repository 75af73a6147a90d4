"""Every query of the catalogue against its SQL."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from wattspan import catalog


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        elif df[c].dtype == object and len(df) and hasattr(df[c].dropna().iloc[0] if df[c].notna().any() else None, "isoformat"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        elif pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sql, name):
    got = plain(catalog.QUERIES[name](spark, str(DATA)).toPandas())
    want = plain(sql.execute(catalog.ORACLE_SQL[name]).df())
    assert len(got) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    """Queries without SQL give rows; other tests hold their operators against plain versions."""
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0
