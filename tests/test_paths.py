"""Ridge contours against walks taken step by step."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import paths


def walk_all(t, threshold):
    """Contours {seed: [(y, x), ...]} by single steps: all walks in full, then ownership and cuts."""
    h, w = t.shape

    def direction(y, x):
        y0, y1, x0, x1 = max(y - 1, 0), min(y + 1, h - 1), max(x - 1, 0), min(x + 1, w - 1)
        gy, gx = (t[y1, x] - t[y0, x]) / max(y1 - y0, 1), (t[y, x1] - t[y, x0]) / max(x1 - x0, 1)
        n = math.sqrt(gy * gy + gx * gx)
        return None if n < 1e-12 else (-gx / n, gy / n)

    half = lambda v: int(math.copysign(math.floor(abs(v) + 0.5), v))

    def step(y, x, s):
        d = direction(y, x)
        if d is None:
            return None
        ny, nx = y + half(d[0] * s), x + half(d[1] * s)
        if not (0 <= ny < h and 0 <= nx < w) or t[ny, nx] < threshold:
            return None
        e = direction(ny, nx)
        return ny, nx, -s if e and d[0] * e[0] + d[1] * e[1] < 0 else s

    walks = {}
    for y in range(h):
        for x in range(w):
            near = t[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]
            if t[y, x] > threshold and t[y, x] >= near.max():
                for k, s in ((0, 1), (1, -1)):
                    path, at = [], (y, x, s)
                    while at and at not in path:
                        path.append(at)
                        at = step(*at)
                    walks[(y * w + x) * 2 + k] = [(p, d) for d, p in enumerate(path) if d >= k]
    first = {}
    for k in sorted(walks):
        for p, d in walks[k]:
            first.setdefault(p, (k, d))
    pixel = {}
    for p, kd in first.items():
        pixel[p[:2]] = min(pixel.get(p[:2], (kd, p[2] < 0, p)), (kd, p[2] < 0, p))
    out = {}
    for k in sorted(walks):
        got = []
        for p, d in walks[k]:
            if first[p] != (k, d) or pixel[p[:2]][2] != p:
                break
            got.append(p[:2])
        walks[k] = got
    for k in [k for k in walks if k % 2 == 0 and walks[k]]:
        points = walks.get(k + 1, [])[::-1] + walks[k]
        if len(points) >= 3:
            out[k // 2] = points
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contours_equal_single_steps(spark, seed):
    rng = np.random.default_rng(seed)
    fields = []
    for n in range(4):
        h, w = rng.integers(9, 26, 2)
        y, x = np.mgrid[:h, :w]
        waves = sum(np.sin(a * y + b * x + c) for a, b, c in rng.uniform(0.2, 1.1, (4, 3)))
        fields.append(np.round((waves - waves.min()) / np.ptp(waves), 2 if n == 0 else 9))
    fields.append(np.full((6, 7), 0.5))
    rows = [(i, 0, y, x, float(v), float(v) * 2) for i, f in enumerate(fields) for (y, x), v in np.ndenumerate(f)]
    df = spark.createDataFrame(rows, "image_id long, ch int, y int, x int, t double, grad double").repartition(3)
    got = {}
    for r in paths.ridge_paths(df, 0.4).orderBy("i").collect():
        got.setdefault((r.image_id, r.comp), []).append(r)
    want = {(i, s): p for i, f in enumerate(fields) for s, p in walk_all(f, 0.4).items()}
    assert set(got) == set(want) and len(want) > 5
    for k, points in want.items():
        assert [(r.y, r.x) for r in got[k]] == points
        assert [r.i for r in got[k]] == list(range(len(points))) and {r.n for r in got[k]} == {len(points)}
        for r, a, b in zip(got[k], points[:1] + points, points[1:] + points[-1:]):
            assert r.orientation == pytest.approx(math.atan2(b[0] - a[0], b[1] - a[1])) and r.grad == 2 * fields[k[0]][r.y, r.x]


def test_a_long_ridge_is_one_contour(spark):
    """A straight crest of 700 cells: its points come in order, in ten or so doublings."""
    n = 700
    df = spark.range(3 * n).selectExpr("0L image_id", "0 ch", "cast(id div 700 as int) y", "cast(id % 700 as int) x").withColumn(
        "t", F.when(F.col("y") == 1, 0.9 + F.when(F.col("x") == 350, 0.01).otherwise(0.0) - F.col("x") * 1e-6).otherwise(0.5 - F.col("y") * 0.05)).withColumn("grad", F.col("t"))
    pts = paths.ridge_paths(df.where("true"), 0.3).orderBy("comp", "i").collect()
    longest = max((r.n for r in pts), default=0)
    assert longest > 300
    for a, b in zip(pts, pts[1:]):
        if a.comp == b.comp:
            assert b.i == a.i + 1 and max(abs(a.y - b.y), abs(a.x - b.x)) == 1
