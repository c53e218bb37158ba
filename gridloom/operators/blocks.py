"""Block transforms, variable block sizes, quantisation and channel prediction."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.constants import AC_STEP_FACTOR, GRADIENT_THRESHOLD
from gridloom.functions import quant
from gridloom.functions.index import mirror_index
from gridloom.functions.numeric import quantize_to_palette
from gridloom.kernels import dct_blocks, idct_blocks
from gridloom.operators.orderstat import dense_position
from gridloom.operators.orders import zigzag_table
from gridloom.operators.stats import block_mean, block_variance, edge_class
from gridloom.session import shuffled
from gridloom.tiling import KEYS, image_sizes, with_extent

BLOCK = [*KEYS, "gy", "gx"]


def _slots(pos, size, bs, overlap):
    """(block index, offset in block) pairs of one axis position, mirrored edges included."""
    p, n = F.col(pos), F.col(size)
    stride, off = (bs // 2, bs // 2) if overlap else (bs, 0)
    count = F.ceil(n / stride)
    covered = (count - 1) * stride - off + bs
    whole = F.array(p)
    outside = F.concat(
        F.sequence(F.lit(-off), F.lit(-1)) if off else F.array().cast("array<int>"),
        F.when(covered > n, F.sequence(n, (covered - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
    )
    near = (p <= bs) | (p >= n - 1 - bs)
    all_pos = F.when(near, F.concat(whole, F.filter(outside, lambda j: mirror_index(j, n) == p))).otherwise(whole)
    # Positions far outside a tiny image can mirror onto any pixel.
    all_pos = F.when(n <= bs, F.concat(whole, F.filter(outside, lambda j: mirror_index(j, n) == p))).otherwise(all_pos)

    def blocks_of(j):
        lo = F.greatest(F.ceil((j + (off - bs + 1)) / stride), F.lit(0))
        hi = F.least(F.floor((j + off) / stride), count - 1)
        hit = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(hit, lambda g: F.struct(g.cast("int").alias("g"), (j - (g * stride - off)).cast("int").alias("i")))

    if not overlap:
        own = F.array(F.struct(F.floor(p / bs).cast("int").alias("g"), (p % bs).cast("int").alias("i")))
        # Only the last partial block mirrors, and it reads at most bs positions back.
        plain = ((n % bs) == 0) | ((n > bs) & (p < 2 * (n - 1) - (F.ceil(n / bs) * bs - 1)))
        return F.when(plain, own).otherwise(F.flatten(F.transform(all_pos, blocks_of)))
    return F.flatten(F.transform(all_pos, blocks_of))


def cut_blocks(plane: DataFrame, bs: int, overlap=False, value="v") -> DataFrame:
    """Row-major block arrays ``vals``; edge blocks are completed by mirroring."""
    df = with_extent(plane)
    df = df.withColumn("_y", F.explode(_slots("y", "h", bs, overlap))).withColumn("_x", F.explode(_slots("x", "w", bs, overlap)))
    v = F.col(value)
    if overlap:
        win = lambda i: F.sin(math.pi * (i + 0.5) / bs)
        v = v * win(F.col("_y.i")) * win(F.col("_x.i"))
    cell = F.struct((F.col("_y.i") * bs + F.col("_x.i")).alias("i"), v.alias("v"))
    packed = df.groupBy(*KEYS, F.col("_y.g").alias("gy"), F.col("_x.g").alias("gx")).agg(
        F.sort_array(F.collect_list(cell)).alias("s"), F.first("h").alias("h"), F.first("w").alias("w")
    )
    return packed.select(*BLOCK, F.lit(bs).alias("bs"), F.col("s.v").alias("vals"), "h", "w")


def block_analyze(plane: DataFrame, bs: int, overlap=False, value="v") -> DataFrame:
    """Block spectra: ``coef`` is the row-major 2-D DCT of each block."""
    return cut_blocks(plane, bs, overlap, value).select(*BLOCK, "bs", dct_blocks("vals").alias("coef"), "h", "w")


def block_synthesize(spectra: DataFrame, overlap=False) -> DataFrame:
    """Plane from block spectra by windowed overlap-add over the summed squared window."""
    px = spectra.select(*BLOCK, "bs", "h", "w", F.posexplode(idct_blocks("coef")).alias("i", "v"))
    bs = F.col("bs")
    stride, off = (bs / 2, bs / 2) if overlap else (bs, F.lit(0))
    r, c = F.floor(F.col("i") / bs), F.col("i") % bs
    px = px.withColumns({
        "y": (F.col("gy") * stride - off + r).cast("int"), "x": (F.col("gx") * stride - off + c).cast("int"),
    }).where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")))
    if not overlap:
        return px.select(*KEYS, "y", "x", "v")
    win = lambda i: F.sin(math.pi * (i + 0.5) / bs)
    w = win(r) * win(c)
    g = px.groupBy(*KEYS, "y", "x").agg(F.sum(F.col("v") * w).alias("v"), F.sum(w * w).alias("w2"))
    return g.select(*KEYS, "y", "x", F.when(F.col("w2") > 1e-15, F.col("v") / F.col("w2")).otherwise(F.col("v")).alias("v"))


def coefficients(spectra: DataFrame) -> DataFrame:
    """Long form: one row per coefficient (u = vertical, w = horizontal frequency)."""
    df = spectra.select(*[c for c in spectra.columns if c != "coef"], F.posexplode("coef").alias("_i", "c"))
    return df.withColumns({"u": F.floor(F.col("_i") / F.col("bs")).cast("int"), "w": (F.col("_i") % F.col("bs")).cast("int")}).drop("_i")


def basis_table(spark, sizes=(8,)) -> DataFrame:
    """(bs, k, i, f): cosine basis; at most 32*32 rows per size."""
    t = spark.range(len(sizes)).select(F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") + 1).cast("int")).alias("bs"))
    side = F.sequence(F.lit(0), F.col("bs") - 1)
    t = t.withColumn("k", F.explode(side)).withColumn("i", F.explode(side))
    return t.withColumn("f", F.cos(math.pi / F.col("bs") * (F.col("i") + 0.5) * F.col("k")))


def dct_relational(plane: DataFrame, bs=8, value="v") -> DataFrame:
    """The same transform by joins and sums only; whole blocks required."""
    basis = F.broadcast(basis_table(plane.sparkSession, (bs,)))  # bs*bs rows
    cell = lambda c: F.floor(F.col(c) / bs).cast("int")
    px = plane.select(*KEYS, cell("y").alias("gy"), cell("x").alias("gx"), (F.col("y") % bs).alias("r"), (F.col("x") % bs).alias("i"), F.col(value).alias("v"))
    rows = px.join(basis, "i").groupBy(*BLOCK, "r", F.col("k").alias("w")).agg(F.sum(F.col("v") * F.col("f")).alias("t"))
    cols = rows.withColumnRenamed("r", "i").join(basis, "i").groupBy(*BLOCK, F.col("k").alias("u"), "w").agg(F.sum(F.col("t") * F.col("f")).alias("c"))
    return cols


def windowed(plane: DataFrame, bs: int, value="v") -> DataFrame:
    """Separable sine window applied inside each block."""
    win = lambda c: F.sin(math.pi * (F.col(c) % bs + 0.5) / bs)
    return plane.select(*KEYS, "y", "x", (F.col(value) * win("y") * win("x")).alias("v"))


def classify_blocks(plane: DataFrame, step, value="v") -> DataFrame:
    """Block size (16 or 32) of every 8x8 cell.

    A 32-block needs sixteen cells whose variance is below step^2 / 4 and no
    edge in its four 16-blocks.
    """
    cells = block_variance(plane, 8, value)
    limit = F.lit(float(step) ** 2 * 0.25)
    up = lambda c, k: F.floor(F.col(c) / k).cast("int")
    smooth = cells.groupBy(*KEYS, up("cy", 4).alias("gy"), up("cx", 4).alias("gx")).agg(
        F.count(F.lit(1)).alias("n"), F.max("var").alias("top")
    ).where((F.col("n") == 16) & (F.col("top") < limit))
    edges = edge_class(block_mean(plane, 16, value)).groupBy(*KEYS, up("y", 2).alias("gy"), up("x", 2).alias("gx")).agg(
        F.every(F.col("kind") == "none").alias("calm")
    ).where("calm")
    merged = smooth.join(shuffled(edges), BLOCK, "left_semi").select(*BLOCK, F.lit(32).alias("m"))
    df = cells.withColumns({"gy": up("cy", 4), "gx": up("cx", 4)}).join(shuffled(merged), BLOCK, "left")
    return df.select(*KEYS, "cy", "cx", F.coalesce("m", F.lit(16)).alias("bs"))


def iter_blocks(cells: DataFrame, overlap=False) -> DataFrame:
    """One row per block in raster order of its first cell: origin or centre, and rank."""
    span = F.col("bs") / 8
    a = cells.select(
        *KEYS, (F.floor(F.col("cy") / span) * span).cast("int").alias("cy"), (F.floor(F.col("cx") / span) * span).cast("int").alias("cx"), "bs"
    ).distinct()
    wide = cells.groupBy(*KEYS).agg((F.max("cx") + 1).cast("long").alias("_gw"))
    a = a.join(wide, list(KEYS)).withColumn("_o", F.col("cy") * F.col("_gw") + F.col("cx"))
    shift = (F.col("bs") / 2).cast("int") if overlap else F.lit(0)
    a = dense_position(a, KEYS, "_o", "block_id")
    return a.select(*KEYS, "block_id", (F.col("cy") * 8 + shift).alias("y0"), (F.col("cx") * 8 + shift).alias("x0"), "bs")


def pixel_blocks(plane: DataFrame, cells: DataFrame, value="v") -> DataFrame:
    """Each pixel with the origin and size of the block that contains it."""
    df = plane.withColumns({"cy": F.floor(F.col("y") / 8).cast("int"), "cx": F.floor(F.col("x") / 8).cast("int")})
    df = df.join(shuffled(cells), [*KEYS, "cy", "cx"])
    origin = lambda c: (F.floor(F.col(c) / F.col("bs")) * F.col("bs")).cast("int")
    return df.select(*KEYS, "y", "x", value, "bs", origin("y").alias("y0"), origin("x").alias("x0"))


def variable_analyze(plane: DataFrame, cells: DataFrame, value="v") -> DataFrame:
    """Spectra of variable-size blocks, scaled so that sizes are comparable.

    Whole blocks are packed from their own pixels; only blocks cut by the image
    edge fetch mirrored pixels, by an equi-join.
    """
    dims = image_sizes(plane)
    df = pixel_blocks(plane, cells, value).join(dims, list(KEYS))
    block = [*KEYS, "y0", "x0", "bs", "h", "w"]
    fits = (F.col("y0") + F.col("bs") <= F.col("h")) & (F.col("x0") + F.col("bs") <= F.col("w"))
    offset = (F.col("y") - F.col("y0")) * F.col("bs") + F.col("x") - F.col("x0")
    inner = df.where(fits).select(*block, offset.alias("i"), F.col(value).alias("v"))
    steps = F.sequence(F.lit(0), F.col("bs") - 1)
    edge = df.where(~fits).select(*block).distinct()
    edge = edge.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps)).select(
        *block, (F.col("_r") * F.col("bs") + F.col("_c")).alias("i"),
        mirror_index(F.col("y0") + F.col("_r"), F.col("h")).alias("y"),
        mirror_index(F.col("x0") + F.col("_c"), F.col("w")).alias("x"),
    )
    edge = edge.join(shuffled(plane.select(*KEYS, "y", "x", F.col(value).alias("v"))), [*KEYS, "y", "x"])
    cells_of = inner.unionByName(edge.select(*inner.columns))
    packed = cells_of.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
    packed = packed.select(*block, dct_blocks(F.col("s.v")).alias("raw"))
    scale = lambda i: F.when(i == 0, 256.0 / (F.col("bs") * F.col("bs"))).otherwise(16.0 / F.col("bs"))
    return packed.withColumn("coef", F.transform("raw", lambda c, i: c * scale(i))).drop("raw")


def variable_synthesize(spectra: DataFrame) -> DataFrame:
    """Inverse of :func:`variable_analyze`."""
    scale = lambda i: F.when(i == 0, F.col("bs") * F.col("bs") / 256.0).otherwise(F.col("bs") / 16.0)
    df = spectra.withColumn("raw", F.transform("coef", lambda c, i: c * scale(i)))
    px = df.select(*KEYS, "y0", "x0", "bs", "h", "w", F.posexplode(idct_blocks("raw")).alias("i", "v"))
    y = (F.col("y0") + F.floor(F.col("i") / F.col("bs"))).cast("int")
    x = (F.col("x0") + F.col("i") % F.col("bs")).cast("int")
    return px.select(*KEYS, y.alias("y"), x.alias("x"), "v", "h", "w").where("y < h and x < w").drop("h", "w")


def qmat_table(spark, sizes=(8, 16, 32), steps=8) -> DataFrame:
    """(bs, angle_idx, u, w, zz, qm): weights; angle_idx -1 is the unrotated surface.

    At most 9 * 1344 rows, fixed by the block sizes.
    """
    zz = zigzag_table(spark, sizes)
    plain = zz.select("bs", F.lit(-1).alias("angle_idx"), "u", "w", "zz", quant.qmat(F.col("u"), F.col("w"), F.col("bs")).alias("qm"))
    turned = zz.withColumn("angle_idx", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    turned = turned.select(
        "bs", "angle_idx", "u", "w", "zz",
        quant.qmat_rotated(F.col("u"), F.col("w"), F.col("bs"), F.col("angle_idx") * (math.pi / steps)).alias("qm"),
    )
    return plain.unionByName(turned)


def quantize(coeffs: DataFrame, weighted=True) -> DataFrame:
    """Quantisation study of AC coefficients.

    Needs per-row columns: bs, u, w, c, q (quality), step, lum (block mean),
    foveal, step_mod, strength, angle and optionally chroma.  ``weighted`` is a
    bool or boolean Column; unweighted rows use one uniform step.  Adds zz,
    pos_step, dz, k (level) and dec (dequantised value).
    """
    on = F.lit(weighted) if isinstance(weighted, bool) else weighted
    df = coeffs.where((F.col("u") > 0) | (F.col("w") > 0))
    turned = on & (F.col("strength") > GRADIENT_THRESHOLD)
    df = df.withColumn("angle_idx", F.when(turned, quant.angle_index(F.col("angle"))).otherwise(F.lit(-1)))
    table = F.broadcast(qmat_table(df.sparkSession))  # bounded by the block sizes
    df = df.join(table, ["bs", "angle_idx", "u", "w"])
    chroma = F.col("chroma") if "chroma" in df.columns else F.lit(1.0)
    base = F.col("step") * chroma * AC_STEP_FACTOR
    tuned = base * F.col("foveal") * quant.psychovisual_pivot(F.col("step_mod"), F.col("q"))
    weight = F.pow("qm", quant.qmat_power(F.col("q"))) * quant.csf_factor(F.col("u"), F.col("w"), F.col("bs"), F.col("lum"))
    slack = F.when(on, 1.0 + 0.3 * (1.0 - F.col("foveal"))).otherwise(1.0)
    dz = quant.dead_zone_at(F.col("zz"), F.col("bs") * F.col("bs") - 1, quant.dead_zone(F.col("q"))) * slack
    df = df.withColumns({
        "pos_step": F.greatest(F.when(on, tuned).otherwise(base), F.lit(0.1)) * F.when(on, weight).otherwise(1.0), "dz": dz,
    })
    df = df.withColumn("k", quant.deadzone_quantize(F.col("c"), F.col("pos_step"), F.col("dz")))
    return df.withColumn("dec", F.col("k") * F.col("pos_step"))


def channel_prediction(luma: DataFrame, chroma: DataFrame, extra=()) -> DataFrame:
    """Predict chroma coefficients from luma ones, block by block.

    Inputs: (image_id, gy, gx, u, w, c); ``extra`` names further chroma keys.
    Returns the chosen alpha (0 when unused), the residual and the
    reconstruction.
    """
    key = ["image_id", "gy", "gx", *extra]
    both = luma.withColumnRenamed("c", "l").join(shuffled(chroma), ["image_id", "gy", "gx", "u", "w"])
    s = both.groupBy(*key).agg(
        F.sum(F.col("l") * F.col("l")).alias("l2"), F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum(F.col("l") * F.col("c")).alias("lc")
    )
    ok = (F.col("l2") >= 1e-4) & (F.col("c2") >= 1e-4)
    r2 = F.when(ok, F.col("lc") * F.col("lc") / (F.col("l2") * F.col("c2")))
    alpha = F.when(ok & (r2 >= 0.25), quantize_to_palette(F.col("lc") / F.col("l2"))).otherwise(F.lit(0.0))
    s = s.select(*key, alpha.alias("alpha"))
    df = both.join(shuffled(s), key)
    res = F.col("c") - F.col("alpha") * F.col("l")
    return df.select(*key, "u", "w", "alpha", (F.col("alpha") != 0).alias("used"), res.alias("residual"), (res + F.col("alpha") * F.col("l")).alias("restored"))


def golden_residual(grid: DataFrame, value="q", tile=256) -> DataFrame:
    """Prediction residual of a quantised grid from its left, upper and diagonal cells."""
    from gridloom.constants import PHI_INV, PHI_INV2, PHI_INV3
    from gridloom.functions.numeric import round_half_away
    from gridloom.tiling import columns, rows, at, owned, tiled

    df = tiled(grid, 1, tile=tile).withColumn("_l", at(value, -1, rows()))
    df = df.withColumns({"_t": at(value, -1, columns()), "_d": at("_l", -1, columns())})
    mix = (F.col("_l") * PHI_INV + F.col("_t") * PHI_INV2 + F.col("_d") * PHI_INV3) / (PHI_INV + PHI_INV2 + PHI_INV3)
    pred = F.when(F.col("_d").isNotNull(), round_half_away(mix)).otherwise(F.coalesce("_l", "_t", F.lit(0)))
    df = owned(df.withColumn("residual", (F.col(value) - pred).cast("int")), tile)
    return df.select(*KEYS, "y", "x", value, "residual")
