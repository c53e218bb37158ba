"""Bi-quadratic surface patches on 16x16 tiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.linear import normal_equations, solve
from gridloom.session import shuffled
from gridloom.tiling import KEYS, with_extent

PATCH = [*KEYS, "x0", "y0", "pw", "ph"]
NAMES = ("a00", "a10", "a01", "a11", "a20", "a02")


def _basis():
    t = lambda p, n: F.when(F.col(n) > 1, F.col(p) / F.greatest(F.col(n) - 1, F.lit(1))).otherwise(0.0)
    dx, dy = t("px", "pw"), t("py", "ph")
    return (F.lit(1.0), dx, dy, dx * dy, dx * dx, dy * dy)


def _evaluate():
    return sum((F.element_at("coef", i + 1) * b for i, b in enumerate(_basis()) if i), F.element_at("coef", 1) * 1.0)


def _fit_tiles(px: DataFrame) -> DataFrame:
    """Coefficients and RMSE of each patch, from the normal equations of its pixels.

    On patches of one or two pixels a side the terms that others already express are 0.
    """
    sums, matrix = normal_equations(_basis(), F.col("v"))
    fit = px.groupBy(*PATCH).agg(*[s.alias(k) for k, s in sums.items()]).select(*PATCH, solve(matrix, 6).alias("coef"))
    err = F.col("v") - _evaluate()
    return px.join(shuffled(fit), PATCH).groupBy(*PATCH).agg(F.first("coef").alias("coef"), F.sqrt(F.avg(err * err)).alias("rmse"))


def fit_patches(plane: DataFrame, step: float, base=16, value="v") -> DataFrame:
    """One patch per tile, edge strips included; tiles with RMSE above step/2 are replaced by four quarters."""
    df = with_extent(plane)
    origin = lambda c: (F.floor(F.col(c) / base) * base).cast("int")
    df = df.select(*KEYS, "y", "x", F.col(value).alias("v"), "h", "w", origin("x").alias("x0"), origin("y").alias("y0"))
    df = df.withColumns({"pw": F.least(F.lit(base), F.col("w") - F.col("x0")), "ph": F.least(F.lit(base), F.col("h") - F.col("y0"))})
    df = df.withColumns({"px": F.col("x") - F.col("x0"), "py": F.col("y") - F.col("y0")})
    whole = _fit_tiles(df)
    split = (F.col("rmse") > step * 0.5) & (F.col("pw") >= 8) & (F.col("ph") >= 8)
    parts = df.join(shuffled(whole.where(split).select(*PATCH)), PATCH, "left_semi")
    right, low = F.col("px") >= F.floor(F.col("pw") / 2), F.col("py") >= F.floor(F.col("ph") / 2)
    hw, hh = F.floor(F.col("pw") / 2).cast("int"), F.floor(F.col("ph") / 2).cast("int")
    parts = parts.select(
        *KEYS, "v", F.when(right, F.col("x0") + hw).otherwise(F.col("x0")).alias("x0"), F.when(low, F.col("y0") + hh).otherwise(F.col("y0")).alias("y0"),
        F.when(right, F.col("pw") - hw).otherwise(hw).alias("pw"), F.when(low, F.col("ph") - hh).otherwise(hh).alias("ph"),
        F.when(right, F.col("px") - hw).otherwise(F.col("px")).alias("px"), F.when(low, F.col("py") - hh).otherwise(F.col("py")).alias("py"),
    )
    both = whole.where(~split).unionByName(_fit_tiles(parts))
    return both.select(*PATCH, "rmse", "coef", *[F.element_at("coef", i + 1).alias(n) for i, n in enumerate(NAMES)])


def render_patches(patches: DataFrame) -> DataFrame:
    """Pixels described by patches (patches tile, they do not overlap)."""
    side = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    px = patches.withColumn("py", side("ph")).withColumn("px", side("pw"))
    return px.select(*KEYS, (F.col("y0") + F.col("py")).alias("y"), (F.col("x0") + F.col("px")).alias("x"), _evaluate().alias("v"))
