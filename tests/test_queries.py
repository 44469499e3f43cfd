"""Every registered query against its SQL on an independent engine, over the smallest data."""

import os
from pathlib import Path

import duckdb
import pytest

from siltstone import plans
from siltstone.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
plans.load()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    found = oracle.execute(ORACLE[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == want
