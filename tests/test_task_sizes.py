"""What a task holds does not grow with the input."""

import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.session import bound_tasks
from gridloom.sources.grids import STRETCH, grid_from_events
from gridloom.sources.sinks import write_zordered


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_dense_cells_are_not_sorted(spark):
    wide = STRETCH + 7
    facts = spark.createDataFrame([(1, 0, 3, 2.0), (1, 0, 3, 4.0), (1, 2, wide - 1, 5.0), (4, 1, STRETCH, None)], "i long, y int, x int, v double")
    grid = grid_from_events(facts, F.col("i"), F.col("y"), F.col("x"), F.col("v"))
    got = {(r.image_id, r.y, r.x): r.v for r in grid.collect()}
    want = {(i, y, x): 0.0 for i in (1, 4) for y in range(3) for x in range(wide)} | {(1, 0, 3): 6.0, (1, 2, wide - 1): 5.0}
    assert got == want and grid.count() == len(want)
    assert not re.search(r"Sort \[[^\]]*\bx#", _plan(grid))


def test_tasks_are_bounded_by_bytes(spark):
    keys = [f"spark.sql.adaptive.{k}" for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.initialPartitionNum")]
    for k in keys:
        spark.conf.unset(k)
    bound_tasks(spark)
    assert [spark.conf.get(k) for k in keys] == ["16m", "1024"]
    spark.conf.set(keys[0], "8m")  # what the session says holds
    bound_tasks(spark)
    assert spark.conf.get(keys[0]) == "8m"
    spark.conf.set(keys[0], "16m")


def test_zordered_files_follow_the_size(spark, plane_of, tmp_path):
    plane = plane_of(*[np.arange(4096.0).reshape(64, 64)] * 6)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "4k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")
    try:
        write_zordered(plane, str(tmp_path / "z"))
    finally:
        spark.conf.set(key, "16m")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(list((tmp_path / "z").glob("*.parquet"))) > 8
    assert spark.read.parquet(str(tmp_path / "z")).count() == plane.count()
