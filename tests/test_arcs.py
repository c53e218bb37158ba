"""Circles of any size are fitted, with their true extent."""
import math

import pytest

from gridloom.operators import structure as gs

SCHEMA = "image_id long, ch int, y int, x int, comp long, e double"


def test_nearly_straight_clusters_keep_their_arc(spark):
    flat = [(0, 0, 0, x, y) for x in range(601) for y in [round(x * (600 - x) / 45000)]]
    ring = [(0, 0, 1, x, y) for x, y in ((5, 4), (4, 5), (5, 6), (6, 5), (5, 5))]
    rows = [(i, c, y, x, k, 1.0) for i, c, k, x, y in flat + ring]
    got = {r.comp: r for r in gs.fit_arcs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 12000 < got[0].radius < 40000 and abs(got[0].cx - 300) < 100
    assert (got[1].cx, got[1].cy, got[1].radius) == (5, 5, 1)


def test_arcs_across_the_cut_have_their_true_extent(spark):
    """Arcs of a radius of 200 cells between two angles; the second and third cross half a turn."""
    arcs = [(-0.5, 1.0), (2.5, 3.9), (2.9, 6.9), (-3.0, -2.5)]
    rows = []
    for k, (a, b) in enumerate(arcs):
        cells = {(round(300 + 200 * math.sin(a + (b - a) * i / 2000)), round(300 + 200 * math.cos(a + (b - a) * i / 2000))) for i in range(2001)}
        rows += [(k, 0, y, x, 7, 1.0) for y, x in cells]
    got = {r.image_id: r for r in gs.fit_arcs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for k, (a, b) in enumerate(arcs):
        turn = round((got[k].ts * math.pi / 128 - a) / (2 * math.pi)) * 2 * math.pi
        assert got[k].ts * math.pi / 128 - turn == pytest.approx(a, abs=0.06)
        assert got[k].te * math.pi / 128 - turn == pytest.approx(b, abs=0.06)
        drawn = gs.render_primitives(spark.createDataFrame([(k, 0, 1, "arc", 0, 0, 0, 0, got[k].cx, got[k].cy, got[k].radius, got[k].ts, got[k].te, 3, 0)],
                                     "image_id long, ch int, prim_id long, kind string, x1 int, y1 int, x2 int, y2 int, cx long, cy long, radius long, ts int, te int, amp int, phase int"))
        cells = {(r[2], r[3]) for r in rows if r[0] == k}
        near = sum(any((r.y + i, r.x + j) in cells for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)) for r in drawn.collect())
        assert near >= 0.95 * drawn.count()


def test_extent_equals_sorted_gaps(spark):
    """Random angles, many to a sector, against the plain rule."""
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(6), []
    for k in range(40):
        lo, span = rng.uniform(-math.pi, math.pi), rng.choice([0.0, 0.001, 1.0, 4.0, 6.2])
        rows += [(k, round(math.remainder(lo + rng.random() * span, 2 * math.pi), 9)) for _ in range(rng.choice([1, 2, 30]))]
    got = {r.k: r for r in gs._circular_extent(spark.createDataFrame(rows, "k long, _a double").select("k", F.col("_a")), ["k"]).collect()}
    for k in got:
        a = sorted({v for i, v in rows if i == k})
        gaps = [(round(x - y, 9), -x, y) for x, y in zip(a, [a[-1] - 2 * math.pi] + a[:-1])]
        g = max(gaps)
        assert got[k].a0 == pytest.approx(-g[1]) and got[k].a1 == pytest.approx(g[2] + 2 * math.pi)
