"""Colour image to quantised levels and back, as table transforms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.color import gct_forward, gct_inverse, tone, tone_inverse
from gridloom.functions.numeric import to_u8
from gridloom.constants import PHI
from gridloom.operators.blocks import block_analyze, block_synthesize, channel_prediction, coefficients, quantize
from gridloom.operators.filters import deblock_smooth, sigma_filter
from gridloom.plans.rate_distortion import block_facts, mean_grid, steps_per_quality
from gridloom.session import cut_lineage
from gridloom.tiling import KEYS, image_sizes

BLOCK = ["image_id", "gy", "gx"]


def color_planes(pixels: DataFrame) -> DataFrame:
    """Three planes: tone-mapped luminance (ch 0) and two chromas (ch 1, 2)."""
    lum, c1, c2 = gct_forward(F.col("r"), F.col("g"), F.col("b"))
    size = [c for c in ("h", "w") if c in pixels.columns]
    planes = F.array(tone(lum), c1, c2)
    return pixels.select("image_id", "y", "x", *size, F.posexplode(planes).alias("ch", "v")).select("image_id", "ch", "y", "x", "v", *size)


def pixels_from_planes(planes: DataFrame) -> DataFrame:
    """RGB bytes from the three planes."""
    pick = lambda k: F.max(F.when(F.col("ch") == k, F.col("v")))
    df = planes.groupBy("image_id", "y", "x").agg(tone_inverse(pick(0)).alias("l"), pick(1).alias("c1"), pick(2).alias("c2"))
    r, g, b = gct_inverse(F.col("l"), F.col("c1"), F.col("c2"))
    return df.select("image_id", "y", "x", to_u8(r).alias("r"), to_u8(g).alias("g"), to_u8(b).alias("b"))


def reconstruct(pixels: DataFrame, q: int, bs=16, clean=True) -> DataFrame:
    """Quantise and decode every image at one quality; returns RGB pixels.

    Chroma blocks are predicted from dequantised luma blocks when that pays.
    Three results feed several branches and are materialised: the spectra, the
    grid of block means and the quantised luma.
    """
    planes = color_planes(pixels)
    dims = image_sizes(pixels.withColumn("ch", F.lit(0))).drop("ch")
    spectra = cut_lineage(block_analyze(planes, bs).drop("h", "w"))
    luma_plane = planes.where("ch = 0")
    grid = cut_lineage(mean_grid(spectra.where("ch = 0")))
    facts = block_facts(grid).drop("ch")
    steps = steps_per_quality(luma_plane, grid, (q,)).select("image_id", "q", "step")
    blocks = cut_lineage(spectra.join(facts, BLOCK).join(steps, "image_id"))
    co = coefficients(blocks).withColumn("chroma", F.when(F.col("ch") == 1, F.lit(PHI)).otherwise(1.0))
    luma = cut_lineage(quantize(co.where("ch = 0")).select("ch", *BLOCK, "bs", "u", "w", "dec"))
    pred = channel_prediction(
        luma.select(*BLOCK, "u", "w", F.col("dec").alias("c")), co.where("ch > 0 and u + w > 0").select("ch", *BLOCK, "u", "w", "c"), extra=["ch"]
    )
    side = co.where("ch > 0").drop("c").join(pred.select("ch", *BLOCK, "u", "w", F.col("residual").alias("c"), "alpha"), ["ch", *BLOCK, "u", "w"])
    base = luma.select(*BLOCK, "u", "w", F.col("dec").alias("l"))
    side = quantize(side).join(base, [*BLOCK, "u", "w"]).withColumn("dec", F.col("dec") + F.col("alpha") * F.col("l"))
    dc = co.where("u = 0 and w = 0").withColumnRenamed("c", "dec")
    slim = lambda d: d.select("ch", *BLOCK, "bs", "u", "w", "dec")
    cell = F.struct((F.col("u") * F.col("bs") + F.col("w")).alias("i"), "dec")
    packed = slim(luma).unionByName(slim(side)).unionByName(slim(dc)).groupBy(*KEYS, "gy", "gx", "bs").agg(F.sort_array(F.collect_list(cell)).alias("s"))
    packed = packed.select(*KEYS, "gy", "gx", "bs", F.col("s.dec").alias("coef")).join(dims, "image_id")
    out = block_synthesize(packed)
    if clean:
        out = cut_lineage(out)
        smooth = deblock_smooth(out.where("ch = 0").join(dims, "image_id"), bs).withColumnRenamed("out", "v")
        smooth = sigma_filter(smooth.join(dims, "image_id"), 4.0).withColumnRenamed("out", "v")
        out = smooth.unionByName(out.where("ch > 0"))
    return pixels_from_planes(out)
