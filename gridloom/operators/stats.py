"""Per-image statistics: block moments, complexity, noise, scene class."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.constants import FOVEAL_K, PHI, SCENE_TUNING, SHAPE_TUNING
from gridloom.functions.numeric import clamp
from gridloom.operators.orderstat import order_statistic
from gridloom.operators.stencil import (
    central_gradient, forward_difference, laplacian, max_neighbour_difference,
)
from gridloom.tiling import KEYS

IMAGE = list(KEYS)


def block_mean(plane: DataFrame, bs=16, value="v") -> DataFrame:
    """Block means as a plane of blocks; partial edge blocks average what exists."""
    cell = lambda c: F.floor(F.col(c) / bs).cast("int").alias(c)
    return plane.groupBy(*KEYS, cell("y"), cell("x")).agg(F.avg(value).alias("v"))


def block_variance(plane: DataFrame, bs=8, value="v") -> DataFrame:
    """Population variance and mean of each bs x bs cell."""
    cell = lambda c, n: F.floor(F.col(c) / bs).cast("int").alias(n)
    v = F.col(value)
    g = plane.groupBy(*KEYS, cell("y", "cy"), cell("x", "cx")).agg(
        F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.count(F.lit(1)).alias("n")
    )
    mean = F.col("s") / F.col("n")
    return g.select(*KEYS, "cy", "cx", (F.col("s2") / F.col("n") - mean * mean).alias("var"), mean.alias("mean"), "n")


def complexity(plane: DataFrame, value="v") -> DataFrame:
    """log2 gradient energy per image and its 0..1 normalisation."""
    d = forward_difference(plane, value)
    h, w = F.max("y") + 1, F.max("x") + 1
    e = d.groupBy(*KEYS).agg(
        F.sum(F.col("dy") * F.col("dy")).alias("sy"), F.sum(F.col("dx") * F.col("dx")).alias("sx"),
        h.cast("long").alias("h"), w.cast("long").alias("w"),
    )
    ny, nx = F.greatest((F.col("h") - 1) * F.col("w"), F.lit(1)), F.greatest(F.col("h") * (F.col("w") - 1), F.lit(1))
    c = F.log2(F.col("sy") / ny + F.col("sx") / nx + 1.0)
    return e.select(*KEYS, c.alias("complexity"), clamp((c - 6.0) / 5.0, 0.0, 1.0).alias("c_norm"))


def noise_sigma(planes: DataFrame, value="v") -> DataFrame:
    """Noise estimate from the Laplacian's median absolute deviation, mean over channels."""
    lap = laplacian(planes, value)
    mid = order_statistic(lap, KEYS, "lap", {"med": 0.5}).drop("n")
    dev = lap.join(mid, IMAGE).withColumn("dev", F.abs(F.col("lap") - F.col("med")))
    mad = order_statistic(dev, KEYS, "dev", {"mad": 0.5})
    return mad.groupBy("image_id").agg(F.avg(F.col("mad") / (0.6745 * math.sqrt(20.0))).alias("sigma"))


def orientation_bin(dy, dx, bins):
    """Half-turn orientation bin of a direction."""
    a = F.pmod(F.atan2(dy, dx), F.lit(math.pi))
    return F.least(F.floor(a / math.pi * bins), F.lit(bins - 1)).cast("int")


def orientation_histogram(grid: DataFrame, bins=4, floor=1.0, value="v") -> DataFrame:
    """Magnitude-weighted share of each orientation; weak gradients are skipped."""
    d = forward_difference(grid, value).withColumn("mag", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    d = d.where(F.col("mag") >= floor).withColumn("bin", orientation_bin(F.col("dy"), F.col("dx"), bins))
    h = d.groupBy(*KEYS, "bin").agg(F.sum("mag").alias("weight"))
    total = h.groupBy(*KEYS).agg(F.sum("weight").alias("total"))
    return h.join(total, IMAGE).select(*KEYS, "bin", "weight", (F.col("weight") / F.col("total")).alias("share"))


def _anisotropy(hist, total):
    """1 - H / ln(bins) of a list of non-negative weight columns."""
    p = [F.when(total > 0, h / F.when(total > 0, total).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)) for h in hist]
    ent = sum((F.when(q > 0, -q * F.ln(F.when(q > 0, q).otherwise(F.lit(1.0)))).otherwise(0.0) for q in p), F.lit(0.0))
    return 1.0 - ent / math.log(len(hist)), p


def anisotropy(hist: DataFrame, bins=4) -> DataFrame:
    """Entropy of the orientation shares and the resulting anisotropy."""
    p = F.col("share")
    ent = F.sum(F.when(p > 0, -p * F.ln(F.when(p > 0, p).otherwise(F.lit(1.0)))).otherwise(0.0))
    return hist.groupBy(*KEYS).agg(ent.alias("entropy"), (1.0 - ent / math.log(bins)).alias("anisotropy"))


def _lookup(table, index):
    out = None
    for name, values in table.items():
        out = (F if out is None else out).when(F.col("scene") == name, F.lit(values[index]))
    return out


def scene_profile(grid: DataFrame, value="v") -> DataFrame:
    """Scene class of each image from a small grid of block means.

    One exchange for the differences, one for the per-image aggregate.
    """
    d = forward_difference(grid, value).withColumn("mag", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    d = d.withColumn("bin", orientation_bin(F.col("dy"), F.col("dx"), 4))
    hist = [F.sum(F.when((F.col("bin") == b) & (F.col("mag") >= 1.0), F.col("mag")).otherwise(0.0)).alias(f"h{b}") for b in range(4)]
    g = d.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("mag") < 3.0, 100.0).otherwise(0.0)).alias("smooth"), *hist
    )
    total = sum((F.col(f"h{b}") for b in range(1, 4)), F.col("h0"))
    an, p = _anisotropy([F.col(f"h{b}") for b in range(4)], total)
    tiny = F.col("n") < 4
    g = g.withColumns({"an": an, "hv": p[0] + p[2]})
    scene = (
        F.when(tiny | (F.col("smooth") > 50.0), "Flat")
        .when((F.col("hv") > 0.6) & (F.col("an") > 0.1), "Architectural")
        .when(F.col("an") > 0.15, "Perspective").when(F.col("smooth") < 15.0, "Organic").otherwise("Mixed")
    )
    g = g.select(
        *KEYS, scene.alias("scene"), F.when(tiny, 100.0).otherwise(F.col("smooth")).alias("smooth_pct"),
        F.when(tiny, 0.0).otherwise(F.col("an")).alias("anisotropy"), tiny.alias("_tiny"),
    )
    return g.select(
        *KEYS, "scene", "smooth_pct", "anisotropy",
        F.when(F.col("_tiny"), 1.0).otherwise(_lookup(SCENE_TUNING, 0)).alias("velvet"),
        _lookup(SCENE_TUNING, 1).alias("step_factor"), _lookup(SCENE_TUNING, 2).alias("deblock"),
        ((F.col("scene") != "Flat") | (F.col("smooth_pct") < 85.0)).alias("lapped"),
    )


def scene_class(plane: DataFrame, step=16, value="v") -> DataFrame:
    """Scene class straight from a plane."""
    return scene_profile(block_mean(plane, step, value))


def shape_profile(prims: DataFrame, sizes: DataFrame) -> DataFrame:
    """Profile of each image's segments and arcs.

    ``prims`` has (image_id, kind, x1, y1, x2, y2, radius); ``sizes`` has
    (image_id, h, w) and decides which images appear.
    """
    seg = F.col("kind") == "segment"
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    length = F.when(seg, F.sqrt(dx * dx + dy * dy)).otherwise(F.col("radius") * math.pi * 0.5)
    p = prims.select("image_id", seg.alias("seg"), length.alias("len"), orientation_bin(dy, dx, 8).alias("bin"))
    hist = [F.coalesce(F.sum(F.when(F.col("seg") & (F.col("bin") == b), F.col("len"))), F.lit(0.0)).alias(f"h{b}") for b in range(8)]
    g = p.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("seg").alias("n_segments"), F.sum("len").alias("total_len"), *hist
    )
    g = sizes.join(g, "image_id", "left").na.fill(0).withColumn("n_arcs", F.col("n") - F.col("n_segments"))
    h = [F.col(f"h{b}") for b in range(8)]
    total = sum(h[1:], h[0])
    an, share = _anisotropy(h, total)
    some = F.col("n") > 0
    ratio = (
        F.when(F.col("n_arcs") > 0, F.col("n_segments") / F.greatest(F.col("n_arcs"), F.lit(1)))
        .when(F.col("n_segments") > 0, 100.0).otherwise(1.0)
    )
    top = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(b).alias("b")) for b, s in enumerate(share)]))
    g = g.withColumns({
        "ratio": ratio, "anisotropy": F.when(some, an).otherwise(0.0),
        "dominant": F.when(some, (top["b"] + 0.5) * math.pi / 8.0).otherwise(0.0),
        "perspective": F.when(F.col("n_segments") > 10, clamp((1.0 - (share[0] + share[4])) * an, 0.0, 1.0)).otherwise(0.0),
        "avg_length": F.when(some, F.col("total_len") / F.greatest(F.col("n"), F.lit(1))).otherwise(0.0),
        "density": F.when(some, F.col("n") / (F.col("h").cast("double") * F.col("w") / 1000.0)).otherwise(0.0),
    })
    scene = (
        F.when(F.col("density") < 0.5, "Flat").when(F.col("perspective") > 0.4, "Perspective")
        .when((F.col("ratio") > 3.0) & (F.col("anisotropy") > 0.3), "Architectural")
        .when(F.col("ratio") < 0.5, "Organic").otherwise("Mixed")
    )
    g = g.withColumn("scene", scene)
    return g.select(
        "image_id", "n", "n_segments", "n_arcs", "ratio", "anisotropy", "dominant", "perspective", "avg_length",
        "density", "scene", *[_lookup(SHAPE_TUNING, i).alias(a) for i, a in enumerate(("radius_factor", "threshold_factor", "deblock"))],
    )


def structure_factor(grid: DataFrame, lo=0.80, hi=1.30, value="v") -> DataFrame:
    """Step factor by local contrast over the image's median contrast."""
    g = max_neighbour_difference(grid, value)
    med = order_statistic(g, KEYS, "grad", {"med": 0.5}).drop("n")
    ratio = clamp(F.col("grad") / F.greatest("med", F.lit(1.0)), 0.0, 3.0)
    t = clamp(ratio / 2.0, 0.0, 1.0)
    return g.join(med, IMAGE).select(*KEYS, "y", "x", clamp(hi + t * (lo - hi), lo, hi).alias("factor"))


def foveal_factor(grid: DataFrame, k=FOVEAL_K, value="v") -> DataFrame:
    """Step factor phi^(-k S) from contrast and darkness of block means in 0..255."""
    g = max_neighbour_difference(grid, value).withColumn("weber", F.col("grad") / (F.abs(F.col(value)) + 10.0))
    top = g.groupBy(*KEYS).agg(F.greatest(F.max("weber"), F.lit(1e-6)).alias("top"))
    dark = 1.0 - clamp(F.col(value) / 255.0, 0.0, 1.0)
    s = 0.6 * F.least(F.col("weber") / F.col("top"), F.lit(1.0)) + 0.4 * dark
    return g.join(top, IMAGE).select(*KEYS, "y", "x", F.pow(F.lit(PHI), -k * s).alias("foveal"))


def edge_class(grid: DataFrame, value="v") -> DataFrame:
    """none / segment / arc of each block, with the gradient direction of segments."""
    g = central_gradient(grid, value)
    med = order_statistic(g, KEYS, "mag", {"med": 0.5}).drop("n")
    df = g.join(med, IMAGE)
    ax, ay = F.abs("dx"), F.abs("dy")
    kind = (
        F.when(F.col("mag") < F.greatest("med", F.lit(0.5)) * 0.5, "none")
        .when(F.greatest(ax, ay) > F.least(ax, ay) * 2.0, "segment").otherwise("arc")
    )
    df = df.withColumn("kind", kind)
    return df.select(
        *KEYS, "y", "x", "kind", F.when(F.col("kind") == "segment", F.atan2("dy", "dx")).otherwise(0.0).alias("angle")
    )


def coherence_factor(coeffs: DataFrame, keys) -> DataFrame:
    """Directional concentration of AC magnitude per block, mapped to 0.8..1."""
    a = F.abs("c")
    ac = coeffs.where((F.col("u") > 0) | (F.col("w") > 0))
    g = ac.groupBy(*keys).agg(
        F.sum(F.when(F.col("u") == 0, a).otherwise(0.0)).alias("eh"),
        F.sum(F.when((F.col("u") > 0) & (F.col("w") == 0), a).otherwise(0.0)).alias("ev"),
        F.sum(F.when((F.col("u") > 0) & (F.col("w") > 0), a).otherwise(0.0)).alias("ed"),
    )
    total = F.col("eh") + F.col("ev") + F.col("ed")
    an = F.greatest("eh", "ev", "ed") / F.when(total > 0, total).otherwise(F.lit(1.0))
    f = clamp(1.0 - 0.2 * F.greatest(an - 0.33, F.lit(0.0)) / 0.67, 0.8, 1.0)
    return g.select(*keys, "eh", "ev", "ed", F.when(total < 1.0, 1.0).otherwise(f).alias("factor"))
