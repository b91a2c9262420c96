"""Every registered batch query against its DuckDB counterpart on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tapeframe.plans import registry

from conftest import SF

QUERIES, ORACLES = registry.queries(), registry.oracles()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("stream_")])
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
