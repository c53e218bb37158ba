"""Saliency field of a coarse grid and its lookup from finer grids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.constants import K_STEP, PHI, SIGMA_A, SIGMA_RATIO
from gridloom.functions.quant import saliency_bucket
from gridloom.operators.orderstat import normalize
from gridloom.operators.stencil import PIXEL, _keep, blurred, gaussian_weights, sobel, with_sobel
from gridloom.session import shuffled
from gridloom.tiling import KEYS, TILE, tiled, with_extent

IMAGE = list(KEYS)


def saliency_field(grid: DataFrame, sigma=SIGMA_A, ratio=SIGMA_RATIO, k_step=K_STEP, value="v", tile=TILE) -> DataFrame:
    """Difference of two blurs of the edge map, with the wide blur's gradient.

    One halo exchange makes the edge map; a second, sized for the wide kernel
    plus one ring, serves both blurs and the gradient of the wide one.
    """
    edges = sobel(with_extent(grid), value, tile).select(*PIXEL, F.col("mag").alias("e"), "h", "w")
    wide = sigma * ratio
    reach, _ = gaussian_weights(wide)
    df = tiled(edges, reach + 1, "clamp", tile)
    df = blurred(df, "e", {"act": sigma, "inh": wide})
    real = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w"))
    df = with_sobel(df.withColumn("inh", F.when(real, F.col("inh"))), "inh")
    df = df.withColumn("dog", F.greatest(F.col("act") - F.col("inh"), F.lit(0.0)))
    df = _keep(df, "dog", F.col("mag").alias("grad"), "angle", tile=tile)
    df = normalize(df, KEYS, "dog", "unit", "t")
    return df.select(*PIXEL, "t", F.pow(F.lit(PHI), -k_step * F.col("t")).alias("step_mod"), "grad", "angle")


def with_strength(field: DataFrame) -> DataFrame:
    """Gradient relative to the image's largest."""
    top = field.groupBy(*KEYS).agg(F.greatest(F.max("grad"), F.lit(1e-6)).alias("_top"))
    return field.join(top, IMAGE).withColumn("strength", F.col("grad") / F.col("_top")).drop("_top")


def lookup_field(cells: DataFrame, field: DataFrame, scale: int = 1) -> DataFrame:
    """Bucket and predicted magnitude for finer cells (y, x), clamped at the field's edge."""
    edge = field.groupBy(*KEYS).agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))
    df = cells.join(edge, IMAGE).withColumns({
        "fy": F.least(F.floor(F.col("y") / scale), F.col("_my")).cast("int"),
        "fx": F.least(F.floor(F.col("x") / scale), F.col("_mx")).cast("int"),
    })
    f = field.select(*KEYS, F.col("y").alias("fy"), F.col("x").alias("fx"), "t", "grad")
    return df.join(shuffled(f), [*IMAGE, "fy", "fx"]).drop("_my", "_mx").withColumn("bucket", saliency_bucket(F.col("t")))


def predicted_magnitude(cells: DataFrame, field: DataFrame, scale: int, calibration=1.0) -> DataFrame:
    return lookup_field(cells, field, scale).select(*PIXEL, (F.col("grad") * calibration).alias("pred"))
