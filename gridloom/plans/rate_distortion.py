"""Rate-distortion study: images x qualities x codecs in one plan.

Blocks are transformed once.  Per-block facts (saliency, contrast, brightness)
are joined while a block is still one row; only then do coefficients and
quality settings multiply.  Rates and distortions come out of one aggregate on
(image, codec, quality, symbol): the distortion is taken in the transform
domain, where it equals the pixel domain's by Parseval's relation, so nothing
needs to be decoded.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import quant
from gridloom.functions.quant import deadzone_quantize
from gridloom.operators.blocks import block_analyze, coefficients, golden_residual, quantize
from gridloom.operators.quality import psnr
from gridloom.operators.saliency import saliency_field, with_strength
from gridloom.operators.sequences import entropy_of_counts
from gridloom.operators.stats import complexity, foveal_factor, scene_profile
from gridloom.session import cut_lineage
from gridloom.tiling import KEYS, image_sizes

QUALITIES = (20, 30, 40, 50, 60, 70, 80, 90)
IMAGE = list(KEYS)
BLOCK = [*KEYS, "gy", "gx"]


def mean_grid(spectra: DataFrame) -> DataFrame:
    """Block means read off the DC coefficients, as a plane of blocks."""
    mean = F.element_at("coef", 1) / (F.col("bs") * F.col("bs"))
    return spectra.select(*KEYS, F.col("gy").alias("y"), F.col("gx").alias("x"), F.round(mean, 9).alias("v"))


def steps_per_quality(plane: DataFrame, grid: DataFrame, qualities=QUALITIES) -> DataFrame:
    """(image_id, ch, q, step): detail step from complexity and scene class."""
    facts = complexity(plane).join(scene_profile(grid).select(*KEYS, "step_factor"), IMAGE)
    facts = facts.withColumn("q", F.explode(F.array(*map(F.lit, qualities))))
    return facts.select(*KEYS, "q", (quant.detail_step(F.col("q"), F.col("c_norm")) * F.col("step_factor")).alias("step"))


def block_facts(grid: DataFrame) -> DataFrame:
    """Per-block quantisation inputs keyed by (gy, gx)."""
    field = with_strength(saliency_field(grid))
    df = grid.join(field, [*IMAGE, "y", "x"]).join(foveal_factor(grid), [*IMAGE, "y", "x"])
    return df.select(
        *KEYS, F.col("y").alias("gy"), F.col("x").alias("gx"), F.col("v").alias("lum"), "t", "step_mod", "strength", "angle", "foveal"
    )


def dc_levels(grid: DataFrame, steps: DataFrame) -> DataFrame:
    """Quantised, range-normalised block means per quality; ``ch`` holds the quality."""
    ranged = grid.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    df = grid.join(ranged, "image_id").join(steps.select("image_id", "q", "step"), "image_id")
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    norm = F.round((F.col("v") - F.col("lo")) * 255.0 / span, 9)
    unit = quant.dc_step(F.col("step"))
    k = deadzone_quantize(norm, unit, quant.dead_zone(F.col("q")))
    return df.select(
        "image_id", F.col("q").alias("ch"), "y", "x", k.alias("q"),
        (F.col("v") - (k * unit * span / 255.0 + F.col("lo"))).alias("err"),
    )


def rd_points(plane: DataFrame, qualities=QUALITIES, bs=8) -> DataFrame:
    """(image_id, codec, q, bpp, psnr) for a weighted and a flat quantiser.

    Rates are order-0 entropies of the AC levels plus those of the predicted DC
    levels.  Exact for images whose sides are multiples of ``bs``.
    """
    spectra = cut_lineage(block_analyze(plane, bs))
    # The grid has one row per block and feeds many branches: compute it once.
    grid = cut_lineage(mean_grid(spectra))
    steps = steps_per_quality(plane, grid, qualities)
    blocks = spectra.select(*BLOCK, "bs", "coef").join(block_facts(grid), BLOCK)
    co = coefficients(blocks).withColumn("c", F.round("c", 9))
    co = co.join(steps, IMAGE).withColumn("codec", F.explode(F.array(F.lit("flat"), F.lit("weighted"))))
    qz = quantize(co, F.col("codec") == "weighted")
    err = F.col("c") - F.col("dec")
    gain = F.when(F.col("u") > 0, 2.0).otherwise(1.0) * F.when(F.col("w") > 0, 2.0).otherwise(1.0)
    ac = qz.groupBy("image_id", "codec", "q", F.col("k").alias("sym")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(err * err * gain / (F.col("bs") * F.col("bs"))).alias("d")
    )
    point = ["image_id", "codec", "q"]
    c = F.col("n")
    bits = F.sum(c) * (F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c))
    ac = ac.groupBy(*point).agg(bits.alias("ac_bits"), F.sum("d").alias("ac_se"))
    dc = dc_levels(grid, steps)
    dc_se = dc.groupBy("image_id", F.col("ch").alias("q")).agg(F.sum(F.col("err") * F.col("err") * (bs * bs)).alias("dc_se"))
    dc_bits = entropy_of_counts(
        golden_residual(dc.drop("err")).groupBy("image_id", F.col("ch").alias("q"), "residual").agg(F.count(F.lit(1)).alias("c")), ["image_id", "q"], "c"
    ).select("image_id", "q", (F.col("n") * F.col("entropy")).alias("dc_bits"))
    size = image_sizes(plane).select("image_id", (F.col("h").cast("double") * F.col("w")).alias("px"))
    df = ac.join(dc_se, ["image_id", "q"]).join(dc_bits, ["image_id", "q"]).join(size, "image_id")
    mse = (F.col("ac_se") + F.col("dc_se")) / F.col("px")
    return df.select(*point, ((F.col("ac_bits") + F.col("dc_bits")) / F.col("px")).alias("bpp"), psnr(mse, 99.0).alias("psnr"))
