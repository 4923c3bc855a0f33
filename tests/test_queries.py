"""Registered queries next to their SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from labelloom.workload import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_registry():
    assert set(oracle_sql()) <= set(queries()) and set(all_queries()) <= set(queries())
    assert all(name[0] in "safpjawlumixg" and name[1:3].isdigit() and name[3] == "_" for name in all_queries())


@needs_data
@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, db, name):
    from tools.check import table
    df = queries()[name](spark, SF)
    cur = db.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(cur.fetchall(), cols)


@needs_data
def test_entry(spark):
    rows = entry(spark).collect()
    assert {"label_name", "precision", "recall", "f1", "support"} == set(rows[0].asDict()) and len(rows) == 4


def test_forest_query_tunes_the_whole_grid(monkeypatch):
    from labelloom.operators.models import GRIDS
    from labelloom.workload import models
    monkeypatch.setattr(models, "_fit", lambda spark, sf, name, grid: (name, grid))
    assert queries()["m11_random_forest"](None, SF) == ("random_forest", GRIDS["random_forest"])
