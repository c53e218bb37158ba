"""Scan orders: zigzag, Z-order and the golden-angle covering order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.constants import GOLDEN_ANGLE
from gridloom.functions.numeric import clamp, round_half_away
from gridloom.operators.orderstat import dense_position
from gridloom.operators.sequences import with_previous
from gridloom.session import shuffled
from gridloom.tiling import KEYS, image_sizes, with_extent


def zigzag_table(spark, sizes=(8, 16, 32)) -> DataFrame:
    """(bs, u, w, zz): position of each non-DC coefficient in its scan; <= 1344 rows."""
    cells = spark.range(len(sizes)).select(
        F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") + 1).cast("int")).alias("bs")
    )
    side = F.sequence(F.lit(0), F.col("bs") - 1)
    cells = cells.withColumn("u", F.explode(side)).withColumn("w", F.explode(side)).where(F.col("u") + F.col("w") > 0)
    s = F.col("u") + F.col("w")
    order = Window.partitionBy("bs").orderBy(s, F.when(s % 2 == 0, -F.col("u")).otherwise(F.col("u")))
    return cells.withColumn("zz", F.row_number().over(order) - 1)


def _spread(v):
    """Insert a zero bit between the 31 low bits of an integer."""
    v = v.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_code(y, x):
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_rank(plane: DataFrame, chunk=1 << 16) -> DataFrame:
    """Z-order position of every cell within its image."""
    df = plane.withColumn("z", morton_code(F.col("y"), F.col("x")))
    return dense_position(df, KEYS, "z", "rank", chunk).drop("z")


def covering_order(plane: DataFrame, chunk=1 << 16) -> DataFrame:
    """Golden-angle order of the cells of each image.

    Step k lands on one cell; a cell's first landing counts, and cells never
    landed on follow in raster order.
    """
    df = with_extent(plane)
    dims = image_sizes(plane)
    h, w = F.col("h"), F.col("w")
    size = h.cast("long") * w
    # One row per image row first, so a large image is generated by many tasks.
    steps = dims.withColumn("_r", F.explode(F.sequence(F.lit(0), h - 1))).repartition("image_id", "_r")
    steps = steps.withColumn("k", F.explode(F.sequence(F.col("_r") * w.cast("long"), (F.col("_r") + 1) * w.cast("long") - 1)))
    cy, cx = h / 2.0, w / 2.0
    r = F.sqrt(F.col("k") / size) * F.sqrt(cy * cy + cx * cx)
    theta = F.col("k") * GOLDEN_ANGLE
    land = lambda mid, trig, n: F.least(
        F.greatest(round_half_away(mid + r * trig(theta)), F.lit(0.0)), n - 1.0
    ).cast("int")
    hits = steps.select(*KEYS, land(cy, F.sin, h).alias("y"), land(cx, F.cos, w).alias("x"), "k")
    hits = hits.groupBy(*KEYS, "y", "x").agg(F.min("k").alias("_k"))
    # One join: the plane is shuffled once for the cells landed on and those that are not.
    both = df.join(shuffled(hits), [*KEYS, "y", "x"], "left").withColumn("_k", F.coalesce("_k", size + F.col("y") * w.cast("long") + F.col("x")))
    return dense_position(both, KEYS, "_k", "rank", chunk).drop("_k", "h", "w")


def inverse_order(order: DataFrame) -> DataFrame:
    """Raster index of each position and position of each raster index."""
    df = with_extent(order)
    return df.select(*KEYS, "rank", (F.col("y") * F.col("w").cast("long") + F.col("x")).alias("raster"))


def monotonicity(order: DataFrame, value="v", slack=0.5) -> DataFrame:
    """Percentage of neighbouring positions where the value falls by more than ``slack``."""
    df = with_previous(order, {"_p": F.col(value)}, KEYS, "rank").where(F.col("_p").isNotNull())
    drop = F.when(F.col(value) < F.col("_p") - slack, 100.0).otherwise(0.0)
    return df.groupBy(*KEYS).agg(F.avg(drop).alias("violations"))
