"""Every registered query of the engine runs; those with SQL give the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from placewright.queries import ORACLES, QUERIES
from placewright.queries.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df):
    import datetime

    def value(v):
        if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v) is True):
            return None
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "item"):
            return value(v.item())
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        return v

    cols = sorted(df.columns)
    return sorted((tuple(value(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


@pytest.mark.parametrize("name", ["x13_layer", "x14_load_dataset"])
def test_layers_of_ids_with_seven_digits(spark, tmp_path, name):
    """Codes cut to six digits are shared by ten places each; the column is one of codes all the same."""
    part = str(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p_partkey + 1000000 AS p_partkey, * EXCLUDE p_partkey FROM '{SF}/part.parquet') TO '{part}'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{part}'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df()
    assert tidy(got) == tidy(want)
