"""The operators with an SQL twin against it."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from meridian.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    connection = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = connection.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({queries.ORACLES[name]}) q").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, frame.select(*columns).collect()), key=key) == sorted(want, key=key)
