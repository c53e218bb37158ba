"""Components as runs: what clusters meet instead of laid-out cells."""

import numpy as np

from gridloom.operators import structure as gs


def test_runs_hold_the_cells_of_components(spark):
    rng = np.random.default_rng(2)
    cells = [(i, 0, int(y), int(x)) for i in range(2) for y, x in np.argwhere(rng.random((9, 150)) < 0.4)]
    mask = spark.createDataFrame(cells, "image_id long, ch int, y int, x int")
    runs = gs.component_runs(mask).collect()
    laid = sorted((r.image_id, r.ch, r.y, x, r.comp) for r in runs for x in range(r.x0, r.x1 + 1))
    assert [c[:4] for c in laid] == sorted(cells) and len(runs) < len(cells)
    assert laid == sorted(tuple(r) for r in gs.connected_components(mask).collect())
