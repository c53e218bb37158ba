"""The covering order joins the plane with its landings once."""

import numpy as np

from gridloom.operators import orders


def test_one_join_of_the_plane(spark, plane_of):
    plane = plane_of(np.arange(30.0).reshape(5, 6)).selectExpr("*", "5 AS h", "6 AS w")
    out = orders.covering_order(plane)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    assert sorted(r["rank"] for r in out.collect()) == list(range(30))
