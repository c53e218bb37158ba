"""Image-pair quality, rate-distortion points and codec comparison."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.quant import rate_bits
from gridloom.functions.linear import normal_equations, solve
from gridloom.tiling import columns, KEYS, rows, at, owned, tiled

IMAGE = list(KEYS)


def psnr(mse, exact=None):
    """Peak signal-to-noise ratio for 0..255; ``exact`` is the value for identical images."""
    ratio = 10.0 * F.log10(255.0 * 255.0 / F.when(mse > 0, mse))
    return ratio if exact is None else F.when(mse < 1e-10, F.lit(exact)).otherwise(ratio)


def pair(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """Pixels of two versions side by side."""
    return original.withColumnRenamed("v", "v_orig").join(decoded.withColumnRenamed("v", "v_dec"), [*KEYS, "y", "x"])


def compare(pairs: DataFrame, bs=8) -> DataFrame:
    """MSE, MAE, PSNR, edge preservation, smoothness ratio and blocking visibility.

    One halo exchange for every neighbour of both versions, one aggregate.
    """
    both = F.struct(F.col("v_orig").alias("o"), F.col("v_dec").alias("d"))
    df = tiled(pairs, 1).withColumn("_p", both)
    df = df.withColumn("_l", at("_p", -1, rows())).withColumn("_r", at("_p", 1, rows()))
    df = df.withColumn("_u", at("_p", -1, columns())).withColumn("_d", at("_p", 1, columns()))
    df = owned(df)
    err = F.col("v_orig") - F.col("v_dec")
    sums = {"se": err * err, "ae": F.abs(err)}
    interior = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_u").isNotNull() & F.col("_d").isNotNull()
    for f, v in (("o", F.col("v_orig")), ("d", F.col("v_dec"))):
        left, right, up, down = (F.col(f"_{n}")[f] for n in "lrud")
        sums[f"edge_{f}"] = F.when(F.col("_r").isNotNull() & F.col("_d").isNotNull(), (down - v) * (down - v) + (right - v) * (right - v)).otherwise(0.0)
        sums[f"g1_{f}"] = F.when(interior, F.abs(right - left) + F.abs(down - up)).otherwise(0.0)
        sums[f"g2_{f}"] = F.when(interior, F.abs(up + down + left + right - 4.0 * v)).otherwise(0.0)
    step = F.abs(F.col("v_dec") - F.col("_l.d"))
    inner, grid = F.col("_l").isNotNull() & (F.col("x") % bs != 0), F.col("_l").isNotNull() & (F.col("x") % bs == 0)
    g = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()],
        F.avg(F.when(grid, step)).alias("seam"), F.avg(F.when(inner, step)).alias("inside"),
    )
    smooth = lambda f: F.when(F.col(f"g1_{f}") > 0, F.col(f"g2_{f}") / F.when(F.col(f"g1_{f}") > 0, F.col(f"g1_{f}"))).otherwise(0.0)
    mse = F.col("se") / F.col("n")
    return g.select(
        *KEYS, mse.alias("mse"), (F.col("ae") / F.col("n")).alias("mae"), psnr(mse).alias("psnr"),
        (F.col("edge_d") / F.col("n") / F.greatest(F.col("edge_o") / F.col("n"), F.lit(1e-10))).alias("edge_preservation"),
        (smooth("d") / F.greatest(smooth("o"), F.lit(1e-10))).alias("smoothness_ratio"),
        F.coalesce(F.col("seam") / F.greatest("inside", F.lit(1e-10)), F.lit(1.0)).alias("blocking"),
    )


def difference_histogram(pairs: DataFrame) -> DataFrame:
    """Largest channel difference of each pixel, counted; <= 256 rows per image.

    ``pairs`` has (image_id, y, x, r, g, b, r2, g2, b2).
    """
    d = [F.abs(F.col(a) - F.col(a + "2")) for a in "rgb"]
    se = sum((x * x for x in d[1:]), d[0] * d[0])
    return pairs.groupBy("image_id", F.greatest(*d).cast("int").alias("diff")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(se).cast("long").alias("se")
    )


def difference_report(pairs: DataFrame, thresholds=range(31)) -> DataFrame:
    """Changed-pixel statistics for every threshold, per image and overall."""
    hist = difference_histogram(pairs).withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    over = F.col("diff") > F.col("t")
    g = hist.groupingSets([["image_id", "t"], ["t"]], "image_id", "t").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("n_diff"),
        F.sum(F.when(over, F.col("n") * F.col("diff"))).alias("s"), F.max("diff").alias("max_diff"), F.sum("se").alias("se"),
    )
    mse = F.greatest(F.col("se") / (3.0 * F.col("n")), F.lit(1e-10))
    return g.select(
        F.coalesce("image_id", F.lit(-1)).alias("image_id"), "t", "n_diff", (100.0 * F.col("n_diff") / F.col("n")).alias("pct"),
        F.coalesce(F.col("s") / F.when(F.col("n_diff") > 0, F.col("n_diff")), F.lit(0.0)).alias("mean_diff"), "max_diff", psnr(mse).alias("psnr"),
    )


def bits_per_pixel(size_bytes, h, w):
    return size_bytes * 8.0 / (h.cast("double") * w)


def compression_ratio(size_bytes, h, w):
    return h.cast("double") * w * 3.0 / size_bytes


def pair_codecs(points: DataFrame, a: str, b: str) -> DataFrame:
    """Rate-distortion points of two codecs side by side."""
    side = lambda c, s: points.where(F.col("codec") == c).select(
        "image_id", "q", F.col("bpp").alias(f"bpp_{s}"), F.col("psnr").alias(f"psnr_{s}")
    )
    return side(a, "a").join(side(b, "b"), ["image_id", "q"])


def compare_codecs(points: DataFrame, a: str, b: str) -> DataFrame:
    """Size and quality of codec a against b with win / loss / neutral marks."""
    df = pair_codecs(points, a, b)
    mark = lambda x, y: F.when(x > y, "win").when(x < y, "loss").otherwise("neutral")
    ratio_a, ratio_b = 24.0 / F.col("bpp_a"), 24.0 / F.col("bpp_b")
    return df.select(
        "image_id", "q", ((ratio_a - ratio_b) / ratio_b * 100.0).alias("size_pct"),
        (F.col("psnr_a") - F.col("psnr_b")).alias("psnr_delta"),
        mark(F.col("bpp_b"), F.col("bpp_a")).alias("size_mark"), mark(F.col("psnr_a"), F.col("psnr_b")).alias("psnr_mark"),
    )


def _cubic_means(curves: DataFrame, keys) -> DataFrame:
    """Mean over [lo, hi] of the least-squares cubic through each curve's points (x, y): keys, n, mean.

    x is centred and scaled before the moments are taken; Simpson's rule
    integrates a cubic exactly.
    """
    spread = curves.groupBy(*keys).agg(F.avg("x").alias("_mid"), ((F.max("x") - F.min("x")) / 2.0).alias("_half"))
    t = lambda x: (x - F.col("_mid")) / F.when(F.col("_half") > 0, F.col("_half")).otherwise(1.0)
    z = t(F.col("x"))
    sums, matrix = normal_equations([F.lit(1.0), z, z * z, z * z * z], F.col("y"))
    fit = curves.join(spread, keys).groupBy(*keys, "_mid", "_half", "lo", "hi").agg(F.countDistinct("x").alias("n"), *[s.alias(k) for k, s in sums.items()])
    fit = fit.withColumn("_c", solve(matrix, 4))

    def at(x):
        v = t(x)
        return F.get("_c", 0) + v * (F.get("_c", 1) + v * (F.get("_c", 2) + v * F.get("_c", 3)))

    return fit.select(*keys, "n", ((at(F.col("lo")) + 4.0 * at((F.col("lo") + F.col("hi")) / 2.0) + at(F.col("hi"))) / 6.0).alias("mean"))


def bd_rate(points: DataFrame, a: str, b: str) -> DataFrame:
    """Mean rate difference of codec a against b per image, in percent.

    Log rate is fitted as a cubic in quality; the difference is averaged over
    the common quality interval.  Null where a curve has fewer than four
    different qualities, has a zero rate, or no interval is common.
    """
    df = pair_codecs(points, a, b)
    span = df.groupBy("image_id").agg(
        F.greatest(F.min("psnr_a"), F.min("psnr_b")).alias("lo"), F.least(F.max("psnr_a"), F.max("psnr_b")).alias("hi"),
        F.min(F.least("bpp_a", "bpp_b")).alias("_least"))
    defined = span.where((F.col("hi") > F.col("lo")) & (F.col("_least") > 0)).drop("_least")
    long = df.join(defined, "image_id").select(
        "image_id", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"psnr_{k}").alias("x"), F.log(f"bpp_{k}").alias("y")) for k in "ab"])).alias("p"))
    means = _cubic_means(long.select("image_id", "lo", "hi", "p.*"), ["image_id", "k"])
    one = means.groupBy("image_id").agg(
        F.min("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("mean"))).alias(f"_{k}") for k in "ab"])
    rate = F.when(F.col("n") >= 4, (F.exp(F.col("_a") - F.col("_b")) - 1.0) * 100.0)
    return span.select("image_id").join(one.select("image_id", rate.alias("bd_rate")), "image_id", "left")


def bd_summary(rates: DataFrame) -> DataFrame:
    """Average over images with a rate, images won, images with a rate and images without one.

    A rate is undefined under four points, without a common quality interval, or
    where a curve has a zero rate.
    """
    there = F.col("bd_rate").isNotNull()
    return rates.agg(
        F.avg(F.when(there, F.col("bd_rate"))).alias("avg_bd_rate"), F.count_if(there & (F.col("bd_rate") < 0)).alias("wins"),
        F.count_if(there).alias("n"), F.count_if(~there).alias("n_undefined"),
    )


def operating_point(points: DataFrame, lam: float) -> DataFrame:
    """Quality minimising distortion + lambda * rate for each image and codec."""
    d = 255.0 * 255.0 / F.pow(F.lit(10.0), F.col("psnr") / 10.0)
    df = points.withColumn("j", d + lam * F.col("bpp"))
    return df.groupBy("image_id", "codec").agg(
        F.min(F.struct("j", "q", "bpp", "psnr")).alias("best")
    ).select("image_id", "codec", "best.q", "best.bpp", "best.psnr", "best.j")


def within_budget(points: DataFrame, max_bpp: float) -> DataFrame:
    """Best quality that fits a rate budget; images that never fit are absent."""
    df = points.where(F.col("bpp") <= max_bpp)
    return df.groupBy("image_id", "codec").agg(F.max(F.struct("psnr", -F.col("q"), "bpp")).alias("best")).select(
        "image_id", "codec", (-F.col("best.col2")).alias("q"), "best.bpp", "best.psnr"
    )


def coefficient_choice(coeffs: DataFrame, keys, p_zero, p_pm1, lam) -> DataFrame:
    """Cheapest level of each coefficient among rounding down, toward zero and zero.

    Needs k (greedy level), c and pos_step.
    """
    k, a = F.col("k"), F.abs("k")
    size = F.abs("c") / F.col("pos_step")
    sign = F.when(F.col("c") >= 0, 1).otherwise(-1)
    toward = F.when(k > 0, k - 1).otherwise(k + 1)
    options = (
        F.when(size < 0.1, F.array(F.lit(0))).when((k == 0) & (size > 0.3), F.array(k, sign)).when(k == 0, F.array(k))
        .when((a <= 4) & (a > 1), F.array(k, toward, F.lit(0))).otherwise(F.array(k, toward))
    )
    def cost(q):
        e = F.col("c") - q * F.col("pos_step")
        return F.struct((e * e + lam * rate_bits(q, p_zero, p_pm1)).alias("j"), F.abs(q).alias("a"), q.alias("q"))
    best = F.array_min(F.transform(options, cost))
    return coeffs.select(*keys, "c", "k", best["q"].alias("chosen"), best["j"].alias("j"))
