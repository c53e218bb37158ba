"""Halo tiles: one exchange per stencil, whatever its shape.

A plane is cut into square tiles.  Each pixel is sent to its own tile and to
the few neighbouring tiles whose stencils reach it, and the result is
partitioned by tile.  Row windows and column windows both contain the tile key,
so Catalyst runs both passes on that single exchange, and no window partition
is larger than one tile edge plus its halo: a huge image spreads over many
tasks.  Border rules other than "no neighbour" are met by *ghost* pixels laid
outside the image, so a stencil never needs to know where the border is.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.index import border_index

KEYS = ("image_id", "ch")
TILE = 256


def rows():
    """Window along a row of a tile."""
    return Window.partitionBy(*KEYS, "ty", "tx", "y").orderBy("x")


def columns():
    """Window along a column of a tile."""
    return Window.partitionBy(*KEYS, "ty", "tx", "x").orderBy("y")



def extent(plane: DataFrame) -> DataFrame:
    """Height and width of every image, one row per (image_id, ch)."""
    return plane.groupBy(*KEYS).agg(
        (F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w")
    )


def image_sizes(plane: DataFrame) -> DataFrame:
    """The same, from the ``h`` and ``w`` columns when the source carries them."""
    if {"h", "w"} <= set(plane.columns):
        return plane.groupBy(*KEYS).agg(F.first("h").alias("h"), F.first("w").alias("w"))
    return extent(plane)


def with_extent(plane: DataFrame) -> DataFrame:
    """Add ``h`` and ``w``; free when the source already carries them.

    Otherwise the plane is read twice: once for its extent and once to carry
    it.  Chains of filters should therefore keep the two columns.
    """
    if {"h", "w"} <= set(plane.columns):
        return plane
    return plane.join(extent(plane), list(KEYS))


def _axis_slots(pos, n, radius, border, tile):
    """All (tile, coordinate) pairs one axis position must be copied to."""
    radius = F.lit(radius)
    p = F.col(pos)
    inner = p % tile
    plain = (inner >= radius) & (inner < tile - radius)
    coords = F.array(p)
    last = None
    if border is not None:
        size = F.col(n)
        plain = plain & (p > radius) & (p < size - 1 - radius)
        outside = F.concat(
            F.sequence(-radius, F.lit(-1)), F.sequence(size, size + (radius - 1))
        )
        ghosts = F.filter(outside, lambda j: border_index(j, size, border) == p)
        near = (p <= radius) | (p >= size - 1 - radius)
        coords = F.when(near, F.concat(coords, ghosts)).otherwise(coords)
        last = F.floor((size - 1) / tile).cast("int")

    def tiles_of(j):
        lo = F.greatest(F.floor((j - radius) / tile), F.lit(0)).cast("int")
        hi = F.greatest(F.floor((j + radius) / tile), F.lit(0)).cast("int")
        if last is not None:
            lo, hi = F.least(lo, last), F.least(hi, last)
        return F.transform(
            F.sequence(lo, hi), lambda t: F.struct(t.alias("t"), j.cast("int").alias("p"))
        )

    own = F.array(F.struct(F.floor(p / tile).cast("int").alias("t"), p.cast("int").alias("p")))
    return F.when(plain, own).otherwise(F.flatten(F.transform(coords, tiles_of)))


def tiled(plane: DataFrame, radius: int, border=None, tile: int = TILE) -> DataFrame:
    """Plane plus halo, partitioned by tile; windows rows() and columns() apply to it.

    ``border`` is None (stencils see nulls outside), "clamp" or "reflect".
    ``radius`` is a number or a column of the plane that is constant in an image.
    """
    df = plane if border is None else with_extent(plane)
    rest = [c for c in df.columns if c not in ("y", "x")]
    df = df.withColumn("_sy", F.explode(_axis_slots("y", "h", radius, border, tile)))
    df = df.withColumn("_sx", F.explode(_axis_slots("x", "w", radius, border, tile)))
    df = df.select(
        *rest,
        F.col("_sy.t").alias("ty"), F.col("_sx.t").alias("tx"),
        F.col("_sy.p").alias("y"), F.col("_sx.p").alias("x"),
    )
    # ``ch`` is left out: a constant channel would be folded out of the window keys
    # and the windows would then ask for another exchange.
    return df.repartition("image_id", "ty", "tx")


def owned(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Drop halo and ghost rows after the stencil has run."""
    keep = (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))
    if {"h", "w"} <= set(df.columns):
        keep = keep & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")) 
    return df.where(keep & (F.col("y") >= 0) & (F.col("x") >= 0)).drop("ty", "tx")


def at(column, offset, window):
    """Value ``offset`` steps along a window; null outside the tile and image."""
    column = F.col(column) if isinstance(column, str) else column
    if offset == 0:
        return column
    return (F.lead(column, offset) if offset > 0 else F.lag(column, -offset)).over(window)


def ring(df: DataFrame, value: str = "v") -> DataFrame:
    """Add the 3x3 neighbourhood as columns n00..n22 (row, column)."""
    row = F.struct(
        at(value, -1, rows()).alias("a"), F.col(value).alias("b"), at(value, 1, rows()).alias("c")
    )
    df = df.withColumn("_r1", row)
    df = df.withColumn("_r0", at("_r1", -1, columns())).withColumn("_r2", at("_r1", 1, columns()))
    cols = {f"n{i}{j}": F.col(f"_r{i}.{f}") for i in range(3) for j, f in enumerate("abc")}
    return df.withColumns(cols).drop("_r0", "_r1", "_r2")


def cross(df: DataFrame, value: str = "v") -> DataFrame:
    """Add the four direct neighbours as columns up, down, left, right."""
    return df.withColumns({
        "left": at(value, -1, rows()), "right": at(value, 1, rows()),
    }).withColumns({"up": at(value, -1, columns()), "down": at(value, 1, columns())})
