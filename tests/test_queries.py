"""Each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import baseline
from formlens.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def in_order(rows):
    return sorted(rows, key=lambda row: [(x is None, str(x)) for x in row])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    wanted = tables.sql(catalogue.ORACLES[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert in_order(rows) == in_order([tuple(plain(r[i]) for i in at) for r in wanted.fetchall()])


@pytest.mark.parametrize("name", sorted(baseline.PLAIN))
def test_query_is_the_plain_one(spark, name):
    columns = baseline.COLUMNS[name]
    found = [[r[c] for c in columns] for r in catalogue.QUERIES[name](spark, SF).collect()]
    if name == "emb_intradiversity":
        assert found[0] == pytest.approx(baseline.PLAIN[name](SF), abs=1e-6)
        return
    # sums of shares in another order may differ in the last place shown
    near = lambda rows: [[pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in row] for row in rows]
    assert sorted(found, key=lambda r: str(r[0])) == near(sorted(map(list, baseline.PLAIN[name](SF)), key=lambda r: str(r[0])))
