"""Cluster queries against their SQL texts on a small fixture."""
import duckdb
import numpy as np
import pytest

from gridloom.catalog import registered
from gridloom.catalog.base import Sql
from gridloom.operators import structure as gs


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(3)
    rows = []
    for img in range(2):
        band = np.zeros((40, 44, 3))
        for k in range(3):
            for t in range(36):
                y, x = 6 + 14 * k + t // 9 * (img + 1), 4 + t
                if y < 40:
                    band[y, x] = rng.normal(0, 9, 3) + 4
        rows += [(img, 0, y, x, *map(float, band[y, x])) for y in range(40) for x in range(44)]
    df = spark.createDataFrame(rows, "image_id long, ch int, y int, x int, lh double, hl double, hh double")
    con = duckdb.connect()
    con.execute("CREATE TABLE bands (image_id BIGINT, ch BIGINT, y BIGINT, x BIGINT, lh DOUBLE, hl DOUBLE, hh DOUBLE)")
    con.executemany("INSERT INTO bands VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    registered()
    from gridloom.catalog import structure as cat

    old, cat._bands_sql = cat._bands_sql, lambda q: q.cte("SELECT * FROM bands")
    yield gs.cut_lineage(gs.clusters(df)), con, cat
    cat._bands_sql = old


@pytest.mark.parametrize("name", ["clusters", "oscillation", "fit_segments", "fit_arcs", "fit_primitives"])
def test_cluster_queries(setup, name):
    points, con, cat = setup
    fn = {"clusters": lambda p: p}.get(name) or getattr(gs, name)
    sql = {"clusters": cat._clusters_sql, "oscillation": cat._osc_sql, "fit_segments": cat._seg_sql, "fit_arcs": cat._arc_sql, "fit_primitives": cat._prims_sql}[name]
    q = Sql()
    rel = sql(q)
    cur = con.execute(q.text(f"SELECT * FROM {rel}"))
    names = [d[0] for d in cur.description]
    got = fn(points)
    cols = [c for c in names if c in got.columns]
    want = sorted(tuple(round(float(v), 6) if not isinstance(v, str) else v for v in (r[names.index(c)] for c in cols)) for r in cur.fetchall())
    have = sorted(tuple(round(float(v), 6) if not isinstance(v, str) else v for v in r) for r in got.select(*cols).collect())
    assert have == want and have
