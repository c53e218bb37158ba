"""Writers for derived tables and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.orders import morton_code
from gridloom.tiling import TILE


def report_rows(points: DataFrame, digits=4) -> DataFrame:
    """Floating columns rounded for a report."""
    kinds = dict(points.dtypes)
    return points.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in points.columns])


def write_report(points: DataFrame, path: str, digits=4):
    """Rate-distortion report as JSON lines."""
    report_rows(points, digits).write.mode("overwrite").json(path)


def write_planes(plane: DataFrame, path: str, buckets=64):
    """Parquet partitioned by image bucket and laid out tile by tile.

    Rows of one tile are written together and sorted, so later stencils read
    neighbouring pixels from the same row groups; one huge image still spreads
    over many files.
    """
    df = plane.withColumns({
        "bucket": F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"),
        "_ty": F.floor(F.col("y") / TILE), "_tx": F.floor(F.col("x") / TILE),
    })
    df = df.repartition("bucket", "image_id", "_ty", "_tx").drop("_ty", "_tx")
    df.sortWithinPartitions("bucket", "image_id", "ch", "y", "x").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_zordered(plane: DataFrame, path: str, files=None, group_bytes=1 << 20, images_first=False):
    """Parquet laid out along the Z-order of cells, with row groups of about ``group_bytes``.

    Range partitions by Morton code, sorted within: a row group covers a compact
    window of cells, and its minima and maxima of y and x let a reader of a
    window skip it.  By default the cells of all images lie together (many small
    images); ``images_first`` lays out image by image (few large ones).  Without
    ``files`` their number follows the size of the plane.
    """
    place = ["image_id", "ch", "_z"] if images_first else ["_z", "image_id", "ch"]
    df = plane.withColumn("_z", morton_code(F.col("y"), F.col("x")))
    df = (df.repartitionByRange(*place) if files is None else df.repartitionByRange(files, *place)).sortWithinPartitions(*place).drop("_z")
    df.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def read_window(spark, path: str, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Cells y0 .. y1 - 1, x0 .. x1 - 1 of all images; row groups outside are skipped by their statistics."""
    return spark.read.parquet(path).where(f"y >= {y0} AND y < {y1} AND x >= {x0} AND x < {x1}")
