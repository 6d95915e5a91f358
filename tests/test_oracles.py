import math

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans.oracles import ORACLES
from netloom.plans.queries import QUERIES

#: Those that build the whole graph take long; one of them is enough here.
SLOW = {"edge_list_named", "graph_counts", "unparented", "discovery_order", "node_document", "node_json", "edge_json", "children_semi", "node_lookup", "edge_styles", "toolbar_counts", "tree_depth"}


@pytest.fixture(scope="module")
def tables(tiny):
    database = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        database.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return database


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "None" if math.isnan(value) else f"{float(value):.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_its_sql(spark, tables, tiny, name):
    frame = QUERIES[name](spark, tiny)
    found = tables.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(found.columns)
    want = [tuple(map(plain, r)) for r in found.select(*(f'"{c}"' for c in columns)).fetchall()]
    got = [tuple(map(plain, r)) for r in frame.select(*columns).collect()]
    assert sorted(got) == sorted(want)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
