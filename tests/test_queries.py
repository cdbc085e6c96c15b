"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from trendloom import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    mine = rows(got.columns, got.collect())
    if name not in plans.ORACLES:
        assert mine or name == "narrative_matches"
        return
    result = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    assert mine == rows(names, result.fetchall())


def test_plans_are_distributed():
    """No query of the engine multiplies tables; joins with one row are marked as such."""
    import inspect

    from trendloom.operators import market, reports, tables, tiering

    for module in (market, reports, tables, tiering):
        for line in inspect.getsource(module).splitlines():
            assert "crossJoin" not in line or "# one row" in line or "one row" in line or "rows.agg" in line, line
