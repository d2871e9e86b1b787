"""Every query against its expected-result SQL, run by DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from shelfwise.plans.catalog import QUERIES
from shelfwise.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else round(value, 9)
    return value if isinstance(value, (bool, int, str)) else str(value)


def rows_of(frame, columns):
    rows = [tuple(map(plain, row)) for row in frame[columns].itertuples(index=False)]
    return sorted(rows, key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_gives_the_expected_rows(spark, sf_dir, duck, name):
    actual = QUERIES[name](spark, sf_dir).toPandas()
    expected = duck.execute(ORACLES[name]).fetchdf()
    columns = sorted(actual.columns)
    assert columns == sorted(expected.columns)
    assert len(expected) > 0
    assert rows_of(actual, columns) == rows_of(expected, columns)
