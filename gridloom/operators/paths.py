"""Ridge contours in walking order.

A walk starts at a local maximum and runs along the ridge, at right angles to
the gradient, one way and then the other; where the direction of the next point
opposes the way come from, it is turned round.  With the sign of its direction a
point has one successor, so walks are a functional graph over (point, sign) and
need no step-by-step pass: pointer doubling tells for every point which walk
reaches it first in order, and at what distance.

Points belong to the walk of the first local maximum in raster order (its
forward half before its backward half).  A half ends before its first point that
belongs to another, or to itself at a smaller distance; maxima that belong to an
earlier walk start none.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.constants import RIDGE_THRESHOLD
from gridloom.functions.numeric import round_half_away
from gridloom.operators.stencil import PIXEL, _keep, local_maxima
from gridloom.operators.structure import CLUSTER, IMAGE, path_orientation
from gridloom.session import cut_lineage, shuffled
from gridloom.tiling import KEYS, cross, tiled, with_extent


def walking_directions(field: DataFrame, value="t") -> DataFrame:
    """Unit vector (dy, dx) along the ridge at each point; null where the field is flat.

    Differences are central, one-sided at the border.
    """
    df = cross(tiled(field, 1), value)
    v = F.col(value)

    def slope(before, after):
        span = F.when(F.col(before).isNotNull() & F.col(after).isNotNull(), 2.0).otherwise(1.0)
        return (F.coalesce(F.col(after), v) - F.coalesce(F.col(before), v)) / span

    df = df.withColumns({"_gy": slope("up", "down"), "_gx": slope("left", "right")})
    length = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    length = F.when(length >= 1e-12, length)
    df = df.withColumns({"dy": -F.col("_gx") / length, "dx": F.col("_gy") / length})
    return _keep(df, value, "dy", "dx", *[c for c in ("grad", "h", "w") if c in field.columns])


def successors(points: DataFrame) -> DataFrame:
    """Graph over states: (image, state, next); a state is twice the point's raster number, plus one for the turned direction.

    ``points`` are the admissible ones, with id (raster number), dy and dx.  A
    step leads to the neighbour that the rounded direction names; without an
    admissible one ``next`` is null.
    """
    step = lambda c, s: (F.col(c) + round_half_away(F.col(f"d{c}") * s)).cast("int")
    turned = F.explode(F.array(F.lit(0), F.lit(1)))
    a = points.select(*PIXEL, "id", "dy", "dx", turned.alias("s"))
    sign = F.when(F.col("s") == 0, 1.0).otherwise(-1.0)
    a = a.select(*KEYS, (F.col("id") * 2 + F.col("s")).alias("state"), "s", "dy", "dx", step("y", sign).alias("y"), step("x", sign).alias("x"))
    b = points.select(*PIXEL, F.col("id").alias("_id"), F.col("dy").alias("_dy"), F.col("dx").alias("_dx"))
    joined = a.join(shuffled(b), PIXEL, "left")
    opposed = F.coalesce(F.col("dy") * F.col("_dy") + F.col("dx") * F.col("_dx"), F.lit(0.0)) < 0
    return joined.select(*KEYS, "state", (F.col("_id") * 2 + F.when(opposed, 1 - F.col("s")).otherwise(F.col("s"))).alias("next"))


def first_walks(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """For every state that a walk reaches: the first walk that does, and its distance there.

    ``starts`` gives (image, state, walk, dist).  Every round doubles the
    distance that pointers cover; when one changes no label, all later ones
    would not either, because a walk that has met an earlier one stays with it.
    """
    label = F.struct("walk", "dist")
    first = starts.groupBy(*KEYS, "state").agg(F.min(label).alias("label"))
    at = cut_lineage(graph.join(first, [*IMAGE, "state"], "left"))
    reach = 1
    while True:
        passed = at.where("label IS NOT NULL AND next IS NOT NULL").select(
            *KEYS, F.col("next").alias("state"), F.struct(F.col("label.walk").alias("walk"), (F.col("label.dist") + reach).alias("dist")).alias("label"))
        best = passed.groupBy(*KEYS, "state").agg(F.min("label").alias("_new"))
        onward = at.select(*KEYS, F.col("state").alias("next"), F.col("next").alias("_far"))
        better = F.when(F.col("_new").isNotNull() & (F.col("label").isNull() | (F.col("_new") < F.col("label"))), F.col("_new"))
        after = cut_lineage(
            at.join(shuffled(onward), [*IMAGE, "next"], "left").join(shuffled(best), [*IMAGE, "state"], "left")
            .select(*KEYS, "state", F.col("_far").alias("next"), F.coalesce(better, F.col("label")).alias("label"), better.isNotNull().alias("_moved"))
        )
        at, reach = after.drop("_moved"), 2 * reach
        if after.where("_moved").isEmpty():
            return at.where("label IS NOT NULL").select(*KEYS, "state", F.col("label.walk").alias("walk"), F.col("label.dist").alias("dist"))


def ridge_paths(field: DataFrame, threshold=RIDGE_THRESHOLD, min_points=3) -> DataFrame:
    """Points of ridge contours in walking order.

    ``field`` has (image_id, ch, y, x, t, grad).  Result: the points with comp
    (raster number of the contour's local maximum), i (place along the contour
    from the end of its backward half), n (points of the contour), t, grad and
    the orientation from the previous to the next point.
    """
    sized = with_extent(field)
    raster = F.col("y") * F.col("w").cast("long") + F.col("x")
    points = cut_lineage(walking_directions(sized).where(F.col("t") >= threshold).withColumn("id", raster))
    graph = cut_lineage(successors(points))
    seeds = local_maxima(sized.select(*PIXEL, "t"), threshold, "t").join(shuffled(points.select(*PIXEL, "id")), PIXEL).select(*KEYS, "id")
    ahead = seeds.select(*KEYS, (F.col("id") * 2).alias("state"), (F.col("id") * 2).alias("walk"), F.lit(0).cast("long").alias("dist"))
    back = seeds.select(*KEYS, (F.col("id") * 2 + 1).alias("state"), (F.col("id") * 2 + 1).alias("walk")).join(shuffled(graph), [*IMAGE, "state"])
    back = back.where("next IS NOT NULL").select(*KEYS, F.col("next").alias("state"), "walk", F.lit(1).cast("long").alias("dist"))
    reached = first_walks(graph, ahead.unionByName(back)).withColumn("id", F.shiftright("state", 1))
    owner = reached.groupBy(*KEYS, "id").agg(F.min(F.struct("walk", "dist", "state")).alias("own"))
    marked = reached.join(shuffled(owner), [*IMAGE, "id"]).withColumn("mine", F.col("own.state") == F.col("state"))
    ends = marked.groupBy(*KEYS, "walk").agg(F.min(F.when(~F.col("mine"), F.col("dist"))).alias("_end"), F.max((F.col("mine") & (F.col("dist") == 0))).alias("_begun"))
    ends = cut_lineage(ends)
    alive = ends.where("_begun").select(*KEYS, F.shiftright("walk", 1).alias("comp"))
    kept = marked.where("mine").join(ends.select(*KEYS, "walk", "_end"), [*IMAGE, "walk"]).where("_end IS NULL OR dist < _end")
    kept = kept.withColumn("comp", F.shiftright("walk", 1)).join(shuffled(alive), CLUSTER, "left_semi")
    back_half = F.col("walk") % 2 == 1
    kept = cut_lineage(kept.select(*CLUSTER, "id", F.when(back_half, -F.col("dist")).otherwise(F.col("dist")).alias("_o")))
    size = kept.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("_first")).where(F.col("n") >= min_points)
    pts = kept.join(size, CLUSTER).withColumn("i", F.col("_o") - F.col("_first")).drop("_o", "_first")
    return path_orientation(pts.join(points.select(*PIXEL, "id", "t", "grad"), [*IMAGE, "id"]).drop("id"))
