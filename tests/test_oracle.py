"""Each registered query against its SQL in DuckDB, on whole tables: rows, columns and values."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidelog.plans.oracles import ORACLES
from tidelog.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    delivered = [column[0] for column in cursor.description]
    assert sorted(delivered) == columns
    picks = [delivered.index(column) for column in columns]
    expected = Counter(tuple(row[i] for i in picks) for row in cursor.fetchall())
    actual = Counter(tuple(row) for row in got.select(*columns).collect())
    assert sum(actual.values()) > 0
    assert actual == expected


def test_entry_yields_rows(spark):
    assert entry(spark).count() > 0
