"""Joins of whole planes: no side of plane size goes through the driver."""

import numpy as np

from gridloom.operators import orders
from gridloom.operators import structure as gs


def _broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastExchange")


def test_plane_sized_sides_are_dealt_out(spark, plane_of):
    plane = plane_of(np.arange(30.0).reshape(5, 6)).selectExpr("*", "5 AS h", "6 AS w")
    assert _broadcasts(orders.covering_order(plane)) == 0
    assert _broadcasts(gs.subtract(*[plane.selectExpr("image_id", "ch", "y", "x", "v AS lh", "v AS hl", "v AS hh")] * 2)) == 0


def test_points_of_clusters_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "points")  # a small file of many rows, as clusters are written
    rows = [(i, 0, y, x, 0, 1.0 + (x * y) % 3, 8 * y + x, 64) for i in range(3) for y in range(8) for x in range(8)]
    spark.createDataFrame(rows, "image_id long, ch int, y int, x int, comp long, e double, i long, n_points long").write.parquet(path)
    points = spark.read.parquet(path)
    sides = lambda df: [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    for fit, joins in ((gs.fit_segments, 2), (gs.fit_arcs, 2)):
        assert sum("strategy=merge" in line for line in sides(fit(points))) >= joins
    assert gs.fit_segments(points).count() == gs.fit_arcs(points).count() == 3
