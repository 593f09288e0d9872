"""Every core query against its SQL twin on the small tables."""

import math
import os

import duckdb
import pytest

from tracegrain.plans import queries as _  # noqa: F401
from tracegrain.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    return v if not isinstance(v, float) else None if math.isnan(v) else float(f"{v:.9g}")


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in registry.ORACLES:
        rel = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted_rows(df.columns, got) == sorted_rows(names, rel.fetchall())
