"""Ordinary tables as planes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage, shuffled

STRETCH = 1024  # cells of a row that are one record while facts join them


def grid_from_events(df: DataFrame, image, y, x, value, width=None) -> DataFrame:
    """Sparse facts to a dense grid per image; missing cells are 0.

    Cells are summed first; the dense cells are generated per stretch of an image
    row from the extent, so the fill is spread over tasks and needs no cross join.  A fact
    without a place in the grid (a null or negative coordinate, or one beyond
    ``width``) ends the job with an error instead of being left out.
    """
    y, x = y.cast("int"), x.cast("int")
    inside = (y >= 0) & (x >= 0) & (x < width if width is not None else F.lit(True))
    place = F.when(F.coalesce(inside, F.lit(False)), y).otherwise(F.raise_error(F.concat(F.lit("a fact lies outside the grid: y, x = "), F.concat_ws(", ", F.array(y, x).cast("array<string>")))))
    facts = df.select(image.cast("long").alias("image_id"), place.alias("y"), x.alias("x"), value.alias("v"))
    sums = cut_lineage(facts.groupBy("image_id", "y", "x").agg(F.sum("v").alias("v")))  # read four times below
    # The grid is common to all images: its size is two numbers.
    size = sums.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    if width is not None:
        size = size.withColumn("w", F.lit(width))
    images = sums.select("image_id").distinct().withColumns({
        "h": size.select("h").scalar(), "w": size.select("w").scalar(),
    })
    # Joined while a stretch of a row is one record: cells are laid out behind the join, so no task sorts them.
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / STRETCH))))
    filled = sums.groupBy("image_id", "y", F.floor(F.col("x") / STRETCH).alias("_s")).agg(F.collect_list(F.struct("x", F.coalesce("v", F.lit(0.0)).alias("v"))).alias("_f"))
    dense = rows.join(shuffled(filled), ["image_id", "y", "_s"], "left")
    first = (F.col("_s") * STRETCH).cast("int")
    xs = F.sequence(first, F.least(first + STRETCH, F.col("w")) - 1)
    given = F.coalesce("_f", F.array().cast("array<struct<x:int,v:double>>"))
    empty = F.transform(F.array_except(xs, given["x"]), lambda i: F.struct(i.alias("x"), F.lit(0.0).alias("v")))
    cells = dense.select("image_id", "y", "h", "w", F.explode(F.concat(given, empty)).alias("_c"))
    return cells.select("image_id", F.lit(0).alias("ch"), "y", F.col("_c.x").alias("x"), F.col("_c.v").alias("v"), "h", "w")


def _tile_position(vec_id, i, tiles_wide, tiles, side):
    b = vec_id % tiles
    return (
        F.floor(vec_id / tiles).cast("long"),
        (F.floor(b / tiles_wide) * side + F.floor(i / side)).cast("int"),
        ((b % tiles_wide) * side + i % side).cast("int"),
    )


def _byte(e):
    return F.floor(F.least(F.greatest(127.5 + 255.0 * e.cast("double"), F.lit(0.0)), F.lit(255.0)) + 0.5)


def plane_from_arrays(df: DataFrame, ident, array, tiles_wide=5, tiles_high=4, side=8) -> DataFrame:
    """Fixed-length arrays as square tiles of larger images, scaled to 0..255."""
    tiles = tiles_wide * tiles_high
    b = F.col("_id") % tiles
    size = df.select(F.col(ident).alias("_id")).groupBy(F.floor(F.col("_id") / tiles).cast("long").alias("image_id")).agg(
        ((F.max(F.floor(b / tiles_wide)) + 1) * side).cast("int").alias("h"), ((F.max(b % tiles_wide) + 1) * side).cast("int").alias("w"))
    # the last image may lack tiles, and then whole rows or columns of them
    sized = df.select(F.col(ident).alias("_id"), F.floor(F.col(ident) / tiles).cast("long").alias("image_id"), array).join(size, "image_id")
    px = sized.select("_id", "h", "w", F.posexplode(array).alias("i", "e"))
    image, y, x = _tile_position(F.col("_id"), F.col("i"), tiles_wide, tiles, side)
    return px.select(
        image.alias("image_id"), F.lit(0).alias("ch"), y.alias("y"), x.alias("x"), _byte(F.col("e")).cast("double").alias("v"), "h", "w",
    )


def rgb_from_arrays(df: DataFrame, ident, array, tiles_wide=5, tiles_high=4, side=8) -> DataFrame:
    """RGB pixels from arrays: the channels mix each element with shifted ones."""
    tiles = tiles_wide * tiles_high
    n = side * side
    at = lambda i, k: F.element_at(F.col(array), (i + k) % n + 1).alias(f"v{k}")
    mixed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(at(i, 0), at(i, 21), at(i, 42)))
    px = df.select(F.col(ident).alias("_id"), F.posexplode(mixed).alias("i", "e"))
    px = px.select("_id", "i", *[_byte(F.col(f"e.v{k}")).alias(f"v{k}") for k in (0, 21, 42)])
    image, y, x = _tile_position(F.col("_id"), F.col("i"), tiles_wide, tiles, side)
    a, b, c = F.col("v0"), F.col("v21"), F.col("v42")
    return px.select(
        image.alias("image_id"), y.alias("y"), x.alias("x"), a.cast("int").alias("r"),
        F.floor((a + b) / 2).cast("int").alias("g"), F.floor((a + 3 * c) / 4).cast("int").alias("b"),
        F.lit(tiles_high * side).alias("h"), F.lit(tiles_wide * side).alias("w"),
    )
