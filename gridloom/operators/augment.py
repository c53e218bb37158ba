"""Deterministic signal-loss effects for datasets of RGB pixels.

Random choices are functions of (seed, image_id, item) only, by integer
arithmetic, so they do not depend on partitioning.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.constants import LCG_MOD, LCG_MUL
from gridloom.functions.numeric import clamp

CELL = 32


def draw(seed: int, stream: int, *items):
    """Uniform integer in [1, 2^31 - 2] from a seed, a stream number and item columns."""
    s = F.lit(seed * 7919 + stream * 104729 + 1).cast("long")
    for item in items:
        s = F.pmod((s + item.cast("long") + 1) * LCG_MUL, F.lit(LCG_MOD))
    return F.pmod(s * LCG_MUL, F.lit(LCG_MOD))


def below(limit, *args):
    """Draw in [0, limit)."""
    return F.pmod(F.floor(draw(*args) / 8), F.greatest(limit, F.lit(1))).cast("int")


def severity(signal):
    """Five effect intensities for a signal strength of 0..100."""
    ramp = lambda limit: F.when(signal < limit, (limit - signal) / limit).otherwise(F.lit(0.0))
    return {n: ramp(l) for n, l in (("zero", 80.0), ("swap", 60.0), ("shift", 45.0), ("freeze", 30.0), ("noise", 15.0))}


def _extent(pixels):
    if {"h", "w"} <= set(pixels.columns):
        return pixels
    dims = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return pixels.join(dims, "image_id")


def _dims(pixels):
    return _extent(pixels).groupBy("image_id").agg(F.first("h").alias("h"), F.first("w").alias("w"))


def _items(dims, count):
    """One row per item of each image; items are drawn independently."""
    n = F.greatest(F.round(count), F.lit(1)).cast("int")
    return dims.withColumn("item", F.explode(F.sequence(F.lit(1), n)))


def rectangles(dims: DataFrame, seed: int, stream: int, count, wide, high) -> DataFrame:
    """(image_id, item, y0, y1, x0, x1) with exclusive ends; ranges are (base, spread)."""
    i = (F.col("image_id"), F.col("item"))
    r = _items(dims, count)
    r = r.withColumns({"x0": below(F.col("w"), seed, stream, *i), "y0": below(F.col("h"), seed, stream + 1, *i)})
    return r.withColumns({
        "x1": F.least(F.col("x0") + wide[0] + below(F.lit(wide[1]), seed, stream + 2, *i), F.col("w")),
        "y1": F.least(F.col("y0") + high[0] + below(F.lit(high[1]), seed, stream + 3, *i), F.col("h")),
    }).drop("h", "w")


def in_rectangles(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Every (pixel, rectangle) containment, found through 32-pixel cells."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))
    r = rects.withColumn("_cy", span("y0", "y1")).withColumn("_cx", span("x0", "x1"))
    p = pixels.withColumns({"_cy": F.floor(F.col("y") / CELL), "_cx": F.floor(F.col("x") / CELL)})
    hit = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return p.join(r, ["image_id", "_cy", "_cx"]).where(hit).drop("_cy", "_cx")


RGB = ("r", "g", "b")


def _paint(pixels, painted):
    """Overwrite pixels; ``painted`` has (image_id, y, x, item, r, g, b), the last item wins."""
    last = painted.groupBy("image_id", "y", "x").agg(F.max(F.struct("item", *RGB)).alias("_p"))
    df = pixels.join(last, ["image_id", "y", "x"], "left")
    return df.select("image_id", "y", "x", *[F.coalesce(F.col(f"_p.{c}"), F.col(c)).alias(c) for c in RGB])


def freeze_blocks(pixels: DataFrame, intensity: float, seed: int, side=(16, 48), count=None) -> DataFrame:
    """Replace random rectangles by their mean colour, slightly tinted.

    Means are taken from the original image; where rectangles overlap, the
    later one shows.  ``count`` overrides the number of rectangles per image.
    """
    dims = _dims(pixels)
    n = F.col("w") * F.col("h") / 2048.0 * intensity if count is None else F.lit(float(count))
    rects = rectangles(dims, seed, 10, n, side, side)
    inside = in_rectangles(pixels, rects)
    mean = inside.groupBy("image_id", "item").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in RGB])
    reach = int(20.0 * intensity)
    i = (F.col("image_id"), F.col("item"))
    tint = lambda c, k: clamp(F.col(c) + below(F.lit(2 * reach + 1), seed, 20 + k, *i) - reach, 0, 255).cast("int").alias(c)
    mean = mean.select("image_id", "item", *[tint(c, k) for k, c in enumerate(RGB)])
    painted = inside.select("image_id", "y", "x", "item").join(mean, ["image_id", "item"])
    return _paint(pixels.select("image_id", "y", "x", *RGB), painted)


def zero_blocks(plane: DataFrame, intensity: float, seed: int, bs=32) -> DataFrame:
    """Zero a share of the bs x bs blocks of each plane."""
    by, bx = F.floor(F.col("y") / bs), F.floor(F.col("x") / bs)
    hit = below(F.lit(10000), seed, 30, F.col("image_id"), by, bx) < int(round(intensity * 0.4 * 10000))
    return plane.withColumn("v", F.when(hit, F.lit(0.0)).otherwise(F.col("v")))


def bands(dims: DataFrame, seed: int, stream: int, count, high, max_shift=None) -> DataFrame:
    """(image_id, item, y0, y1[, shift]): horizontal bands, exclusive end."""
    i = (F.col("image_id"), F.col("item"))
    b = _items(dims, count).withColumn("y0", below(F.col("h"), seed, stream, *i))
    b = b.withColumn("y1", F.least(F.col("y0") + high[0] + below(F.lit(high[1]), seed, stream + 1, *i), F.col("h")))
    if max_shift is not None:
        reach = F.floor(max_shift).cast("int")
        b = b.withColumn("shift", below(2 * reach + 1, seed, stream + 2, *i) - reach)
    return b


def _band_rows(b, agg):
    """One row per covered image row."""
    rows = b.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    return rows.groupBy("image_id", "y").agg(agg)


def swap_channels(pixels: DataFrame, intensity: float, seed: int, a="c1", b="c2") -> DataFrame:
    """Swap two channels in random bands; two overlapping swaps cancel."""
    n = F.col("h") * (intensity * 0.15)
    rows = _band_rows(bands(_dims(pixels), seed, 40, n, (4, 16)), F.count(F.lit(1)).alias("_n"))
    df = pixels.join(rows, ["image_id", "y"], "left")
    odd = (F.coalesce("_n", F.lit(0)) % 2) == 1
    return df.withColumns({
        a: F.when(odd, F.col(b)).otherwise(F.col(a)), b: F.when(odd, F.col(a)).otherwise(F.col(b)),
    }).drop("_n")


def shift_rows(pixels: DataFrame, intensity: float, seed: int, count=0.12, reach=0.15, high=(1, 12)) -> DataFrame:
    """Cyclic horizontal shift of random bands; overlapping shifts add up."""
    df = _extent(pixels)
    plan = bands(_dims(pixels), seed, 50, F.col("h") * (intensity * count), high, F.col("w") * (reach * intensity))
    rows = _band_rows(plan, F.sum("shift").alias("_s"))
    df = df.join(rows, ["image_id", "y"], "left")
    x = F.pmod(F.col("x") + F.coalesce("_s", F.lit(0)), F.col("w")).cast("int")
    return df.withColumn("x", x).select(*pixels.columns)


def shift_plane(plane: DataFrame, intensity: float, seed: int) -> DataFrame:
    """The same for one plane, with its own band density."""
    return shift_rows(plane, intensity, seed, 0.1, 0.1, (2, 8))


# The five patch base colours.
PATCH_COLORS = ((0, 255, 0), (255, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0))


def noise_patches(pixels: DataFrame, intensity: float, seed: int) -> DataFrame:
    """Patches of a saturated base colour with +-40 noise per channel."""
    dims = _dims(pixels)
    rects = rectangles(dims, seed, 60, F.col("w") * F.col("h") / 1024.0 * intensity, (4, 32), (1, 8))
    i = (F.col("image_id"), F.col("item"))
    pick = below(F.lit(5), seed, 70, *i)
    at = (F.col("image_id"), F.col("item"), F.col("y"), F.col("x"))
    hit = in_rectangles(pixels.select("image_id", "y", "x"), rects).withColumn("_k", pick)
    base = lambda c: F.element_at(F.array(*[F.lit(p[c]) for p in PATCH_COLORS]), F.col("_k") + 1)
    value = lambda c: clamp(base(c) + below(F.lit(80), seed, 71 + c, *at) - 40, 0, 255).cast("int")
    painted = hit.select("image_id", "y", "x", "item", *[value(k).alias(c) for k, c in enumerate(RGB)])
    return _paint(pixels.select("image_id", "y", "x", *RGB), painted)
