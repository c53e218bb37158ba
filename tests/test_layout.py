"""Z-ordered planes: the same rows, and few row groups for a window."""
import glob

import pyarrow.parquet as pq

from gridloom.sources import read_window, write_zordered


def groups(path, y0, y1, x0, x1):
    """(row groups a reader of the window opens, all of them), by their statistics."""
    hit = n = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i).statistics for i in range(meta.num_columns)}
            n += 1
            hit += cols["y"].min < y1 and cols["y"].max >= y0 and cols["x"].min < x1 and cols["x"].max >= x0
    return hit, n


def test_a_window_opens_a_bounded_share_of_row_groups(spark, tmp_path):
    plane = spark.range(64 * 64 * 12).selectExpr("id % 12 as image_id", "0 as ch", "cast(id div 12 % 64 as int) as y", "cast(id div 768 as int) as x", "cast(hash(id) as double) as v")
    z, raster = str(tmp_path / "z"), str(tmp_path / "raster")
    write_zordered(plane, z, 8, 1 << 14)
    plane.repartitionByRange(8, "y", "x").sortWithinPartitions("y", "x").write.option("parquet.block.size", 1 << 14).parquet(raster)
    want = sorted(map(tuple, plane.where("y >= 16 AND y < 24 AND x >= 40 AND x < 48").collect()))
    assert sorted(map(tuple, read_window(spark, z, 16, 24, 40, 48).collect())) == want and len(want) == 64 * 12
    (hit, n), (rows_hit, rows_n) = groups(z, 16, 24, 40, 48), groups(raster, 16, 24, 40, 48)
    assert n >= 32 and hit <= max(4, n / 16) and hit / n < rows_hit / rows_n
    plan = read_window(spark, z, 16, 24, 40, 48)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y,16)" in plan


def test_large_images_are_laid_out_one_by_one(spark, tmp_path):
    plane = spark.range(2 * 32 * 32).selectExpr("id div 1024 as image_id", "0 as ch", "cast(id div 32 % 32 as int) as y", "cast(id % 32 as int) as x", "cast(id as double) as v")
    write_zordered(plane, str(tmp_path / "p"), 4, images_first=True)
    for f in glob.glob(f"{tmp_path}/p/*.parquet"):
        ids = pq.read_table(f).column("image_id").to_pylist()
        assert ids == sorted(ids)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2048
