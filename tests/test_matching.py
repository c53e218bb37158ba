"""Matching lays the points of contours into bins, and each primitive once."""

import math

import numpy as np

from gridloom.operators import structure as gs


def test_primitives_are_not_multiplied(spark):
    rng = np.random.default_rng(8)
    points = [(0, 0, comp, int(y), int(x), i, 0.5, 3.0) for comp in range(3) for i, (y, x) in enumerate(rng.integers(0, 24, (6, 2)))]
    contours = spark.createDataFrame(points, "image_id long, ch int, comp long, y int, x int, i long, orientation double, grad double")
    ends = rng.integers(0, 200, (40, 4)).tolist()
    prims = [(0, 0, k, "segment", y1, x1, y1 + y2 % 20, x1 + x2 % 20, 0, 0, 1, 3) for k, (y1, x1, y2, x2) in enumerate(ends)]
    prims = spark.createDataFrame(prims, "image_id long, ch int, prim_id long, kind string, y1 int, x1 int, y2 int, x2 int, cx int, cy int, radius int, amp int")
    out = gs.match_primitives(prims, contours)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    generated = [line.split("sequence(")[1].split("#")[0] for line in plan.split("\n") if "Generate explode" in line]
    assert generated and not any("my" in g or "mx" in g for g in generated)
    got = {r.prim_id: (r.comp, r.dist) for r in out.collect()}
    for k, (y1, x1, y2, x2) in enumerate(ends):
        a, b = (y1 / 8, x1 / 8), ((y1 + y2 % 20) / 8, (x1 + x2 % 20) / 8)
        m = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        found = []
        for comp in range(3):
            mine = [(y, x) for _, _, c, y, x, *_ in points if c == comp]
            if min(math.dist(m, q) for q in mine) <= gs.MATCH_RADIUS:
                found.append((max(min(math.dist(e, q) for q in mine) for e in (a, b)), comp))
        want = min(found, default=(math.inf, None))
        assert got[k][0] == (want[1] if want[0] < gs.MATCH_DISTANCE_MAX else None)
        if got[k][0] is not None:
            assert math.isclose(got[k][1], want[0], abs_tol=1e-9)
    assert any(c is not None for c, _ in got.values())
