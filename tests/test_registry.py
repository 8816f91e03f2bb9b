"""Every registered weather query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest
from conftest import SMALL

from meridian.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.7g}"
    return str(x)


def rows_of(rows):
    return sorted(([plain(v) for v in r] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_oracle(spark, duck, name):
    frame = registry.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = rows_of(frame.select(*columns).collect())
    if name not in registry.ORACLES:  # custom state: tests/test_streaming.py
        return
    answer = duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({registry.ORACLES[name]}) q")
    assert got == rows_of(answer.fetchall())
