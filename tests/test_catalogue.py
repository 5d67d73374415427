"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import catalogue

EMPTY_OK = {"exact_duplicates", "quality_gate", "benchmark_guard"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(int(v)) if hasattr(v, "__index__") else str(v)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    found = catalogue.queries()[name](spark, sf_dir).toPandas()
    if name not in EMPTY_OK:
        assert len(found)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows_of(found) == rows_of(want)


def test_flagship(spark, sf_dir):
    rows = catalogue.flagship(spark, sf_dir).collect()
    assert rows and all(1 <= r.anchor_nodes <= r.total_nodes and r.skeleton_text for r in rows)
