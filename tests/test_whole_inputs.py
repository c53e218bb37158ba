"""Catalog queries on small tables of their own: nothing of the input is cut away."""
import datetime as dt

import duckdb
import numpy as np
import pytest

from gridloom.catalog import base, registered


@pytest.fixture(scope="module")
def ship(spark, tmp_path_factory):
    """Two suppliers with small quantities on most days of half a year, and the table's folder."""
    folder = str(tmp_path_factory.mktemp("ship"))
    rng = np.random.default_rng(11)
    rows = [(s, dt.datetime(1995, m, d), float(rng.integers(5, 50))) for s in (1, 2) for m in range(1, 7) for d in range(1, 29) if rng.random() < 0.8]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(k, k % 11) for k in range(1, 40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return folder, rows


def sql_rows(name, folder):
    """Rows of a query's SQL text."""
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(base.text(registered()[name]))
    return [d[0] for d in cur.description], sorted(cur.fetchall())


@pytest.mark.parametrize("name", ["connected_components_ship", "subtract_rendered"])
def test_queries_equal_their_sql_on_whole_input(spark, ship, name):
    names, want = sql_rows(name, ship[0])
    got = sorted(tuple(r) for r in base.run(registered()[name], spark, ship[0]).select(*names).collect())
    assert len(got) == len(want) > 100
    assert np.allclose(np.array(got, float), np.array(want, float), atol=2e-6)


def test_small_differences_reach_the_clusters(spark, ship):
    points = base.run(registered()["clusters"], spark, ship[0]).collect()
    energy = {}
    for s in (1, 2):
        v = np.zeros((6, 31))
        for k, day, q in ship[1]:
            if k == s:
                v[day.month - 1, day.day - 1] += q
        v = v[:, : max(d.day for _, d, _ in ship[1])]
        dx, dy = np.zeros(v.shape), np.zeros(v.shape)
        dx[:, :-1], dy[:-1] = np.diff(v, axis=1), np.diff(v, axis=0)
        assert max(abs(dx).max(), abs(dy).max(), abs(dx + dy).max()) < 150
        e = (abs(dx) + abs(dy) + abs(dx + dy)) / 8
        energy |= {(s, y, x): e[y, x] for y, x in zip(*np.nonzero(e > 0.5))}
    got = {(r.image_id, r.y, r.x): r.e for r in points if r.x < 30}
    assert len(energy) > 200 and all(abs(got[k] - e) < 1e-5 for k, e in energy.items() if k[2] < 27)
    assert len({(r.image_id, r.comp) for r in points}) == 2


@pytest.mark.parametrize("y, x", [(-1, 0), (0, -2), (0, 5), (None, 0), (0, None)])
def test_facts_outside_the_grid_are_refused(spark, y, x):
    from pyspark.sql import functions as F

    from gridloom.sources.grids import grid_from_events

    inner = spark.createDataFrame([(1, 0, 4, 2.0), (1, 1, 0, 3.0)], "i long, y int, x int, v double")
    grid = lambda df: grid_from_events(df, F.col("i"), F.col("y"), F.col("x"), F.col("v"), 5)
    assert grid(inner).agg(F.sum("v")).first()[0] == 5.0
    with pytest.raises(Exception, match="outside the grid"):
        grid(inner.union(spark.createDataFrame([(1, y, x, 1.0)], "i long, y int, x int, v double")))
