import math

import duckdb
import pytest

from netloom.llm import ORACLES, QUERIES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    frame, found = QUERIES[name](spark, tiny), database.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(found.columns)
    want = sorted(tuple(map(plain, r)) for r in found.select(*(f'"{c}"' for c in columns)).fetchall())
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got == want and want
