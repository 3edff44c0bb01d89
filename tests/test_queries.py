"""Every registered query against its SQL in a second engine."""

import glob
import math
import os

import duckdb
import pytest

from lexspark.plans import REGISTRY

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    query = REGISTRY[name]
    got = query.run(spark, SF)
    rows = got.collect()
    if query.oracle is None:
        assert rows
        return
    want = duck.execute(query.oracle)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.columns, rows) == ordered(columns, want.fetchall())


def test_inventory():
    """Each family of operators is shown by some query."""
    shown = {op for q in REGISTRY.values() for op in q.ops}
    for family, n in {"C": 19, "V": 9, "K": 15, "O": 13}.items():
        assert sum(op[0] == family for op in shown) >= n - 3, family
