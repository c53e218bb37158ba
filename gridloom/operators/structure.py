"""Connected structures, primitive fitting, rendering and ridge matching."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.constants import (
    BAND_HH, BAND_HL, BAND_LH, MATCH_AMP, MATCH_ANGLE, MATCH_DISTANCE_MAX, MATCH_POS, MATCH_RADIUS, PHI_FREQ,
    RIDGE_THRESHOLD,
)
from gridloom.functions.numeric import angle_diff, clamp, round_half_away, snap_to_levels
from gridloom.operators.orderstat import dense_position, order_statistic
from gridloom.operators.stencil import box_extreme, local_maxima
from gridloom.session import cut_lineage, shuffled
from gridloom.tiling import KEYS, owned, tiled, with_extent

IMAGE = list(KEYS)
PIXEL = [*KEYS, "y", "x"]
BIN = 64


def mask_runs(mask: DataFrame, chunk=1 << 12) -> DataFrame:
    """Horizontal runs of set pixels: (y, x0, x1).  Runs stop at chunk borders."""
    px = mask.withColumn("_c", F.floor(F.col("x") / chunk))
    w = Window.partitionBy(*KEYS, "y", "_c").orderBy("x")
    px = px.withColumn("_g", F.col("x") - F.row_number().over(w))
    return px.groupBy(*KEYS, "y", "_c", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_c", "_g")


def _touching(runs: DataFrame) -> DataFrame:
    """Pairs of run ids that touch in the same or the next row (8-connectivity).

    Runs are spread over 64-pixel bins, so a join key meets few runs.
    """
    first, last = F.floor((F.col("x0") - 1) / BIN), F.floor((F.col("x1") + 1) / BIN)
    binned = runs.withColumn("_b", F.explode(F.sequence(first, last)))
    up = binned.select(*KEYS, "_b", F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y"), F.col("y").alias("ya"),
                       F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("id").alias("src"))
    down = binned.select(*KEYS, "_b", "y", "x0", "x1", F.col("id").alias("dst"))
    hit = up.join(shuffled(down), [*KEYS, "_b", "y"]).where(
        (F.col("src") != F.col("dst")) & (F.col("a0") <= F.col("x1") + 1) & (F.col("x0") <= F.col("a1") + 1)
    )
    e = hit.select(*KEYS, "src", "dst").distinct()
    return e.unionByName(e.select(*KEYS, F.col("dst").alias("src"), F.col("src").alias("dst")))


def _follow(hook: DataFrame) -> DataFrame:
    """Follow hooks to their ends; every step doubles the distance covered."""
    hook = cut_lineage(hook)
    while True:
        higher = hook.select(*KEYS, F.col("label").alias("up"), F.col("up").alias("_top"))
        far = cut_lineage(hook.join(shuffled(higher), [*IMAGE, "up"]).select(*KEYS, "label", F.col("_top").alias("up"), (F.col("_top") != F.col("up")).alias("_moved")))
        hook = far.select(*KEYS, "label", "up")
        if far.where("_moved").isEmpty():
            return hook


def connected_components(mask: DataFrame, max_rounds=60) -> DataFrame:
    """8-connected components of set pixels (image_id, ch, y, x); labels in raster order."""
    return component_runs(mask, max_rounds).select(*KEYS, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "comp")


def component_runs(mask: DataFrame, max_rounds=60) -> DataFrame:
    """The same as runs of pixels: (image_id, ch, y, x0, x1, comp).

    Nodes are pixel runs.  Each round hooks every node to its smallest
    neighbour, follows the hooks, and contracts the graph to the surviving
    nodes, so edges shrink geometrically and a few rounds suffice.  Rounds are
    materialised in the checkpoint folder.
    """
    dims = mask.groupBy(*KEYS).agg((F.max("x") + 1).cast("long").alias("_w"))
    runs = mask_runs(mask).join(dims, IMAGE)
    runs = cut_lineage(runs.select(*KEYS, "y", "x0", "x1", (F.col("y") * F.col("_w") + F.col("x0")).alias("id")))
    edges = cut_lineage(_touching(runs))
    labels = runs.select(*KEYS, "id", F.col("id").alias("label"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        hook = edges.groupBy(*KEYS, F.col("src").alias("label")).agg(F.min("dst").alias("_m"))
        hook = hook.select(*KEYS, "label", F.least("label", "_m").alias("up"))
        hook = _follow(hook)
        labels = cut_lineage(
            labels.join(shuffled(hook), [*IMAGE, "label"], "left").select(*KEYS, "id", F.coalesce("up", "label").alias("label"))
        )
        root = lambda end: hook.select(*KEYS, F.col("label").alias(end), F.col("up").alias(f"_{end}"))
        edges = edges.join(shuffled(root("src")), [*IMAGE, "src"]).join(shuffled(root("dst")), [*IMAGE, "dst"])
        edges = cut_lineage(
            edges.where(F.col("_src") != F.col("_dst")).select(*KEYS, F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    order = dense_position(labels.select(*KEYS, "label").distinct(), KEYS, "label", "comp")
    named = runs.join(shuffled(labels), [*IMAGE, "id"]).join(shuffled(order), [*IMAGE, "label"])
    return named.select(*KEYS, "y", "x0", "x1", "comp")


def clusters(bands: DataFrame, threshold=0.5, radius=2, least_points=13) -> DataFrame:
    """Points of each cluster of energetic cells.

    ``bands`` is a dense grid (image_id, ch, y, x, lh, hl, hh).  Cells within
    ``radius`` of each other join one cluster; clusters of fewer than
    ``least_points`` cells are no clusters.  Both hold for images of any size.
    """
    df = with_extent(bands).withColumn("e", F.abs("lh") + F.abs("hl") + F.abs("hh"))
    df = df.withColumn("m", (F.col("e") > threshold).cast("int"))
    df = cut_lineage(df.select(*PIXEL, "e", "m", "h", "w"))
    grown = box_extreme(tiled(df.select(*PIXEL, "m", "h", "w"), radius), "m", radius, F.max, "_g")
    grown = cut_lineage(owned(grown).where("_g = 1").select(*PIXEL))
    # A point lies in one run of its row: cells of components are never laid out to meet it.
    comp = cut_lineage(component_runs(grown)).withColumn("_b", F.explode(F.sequence(F.floor(F.col("x0") / BIN), F.floor(F.col("x1") / BIN))))
    pts = df.where("m = 1").select(*PIXEL, "e", "h", "w", F.floor(F.col("x") / BIN).alias("_b")).join(shuffled(comp), [*KEYS, "y", "_b"])
    pts = pts.where((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1"))).drop("_b", "x0", "x1")
    size = pts.groupBy(*KEYS, "comp").agg(F.count(F.lit(1)).alias("n_points"))
    pts = pts.join(size, [*IMAGE, "comp"]).where(F.col("n_points") >= least_points)
    order = F.col("y") * F.col("w").cast("long") + F.col("x")
    pts = dense_position(pts.withColumn("_o", order), [*KEYS, "comp"], "_o", "i")
    return pts.select(*PIXEL, "comp", "e", "i", "n_points")


CLUSTER = [*KEYS, "comp"]


def oscillation(points: DataFrame) -> DataFrame:
    """Amplitude and phase of the natural oscillation along each cluster."""
    a = 2.0 * math.pi * PHI_FREQ * F.col("i")
    g = points.groupBy(*CLUSTER).agg(
        F.sum(F.col("e") * F.sin(a)).alias("s"), F.sum(F.col("e") * F.cos(a)).alias("c"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        *CLUSTER, (F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) * 2.0 / F.col("n")).alias("amp_raw"),
        F.atan2("c", "s").alias("phase_raw"),
    )


def fit_segments(points: DataFrame) -> DataFrame:
    """End points of each cluster along its weighted principal axis (>= 3 points)."""
    w, x, y = F.greatest(F.abs("e"), F.lit(1e-9)), F.col("x"), F.col("y")
    mid = points.groupBy(*CLUSTER).agg(
        F.sum(w).alias("sw"), (F.sum(x * w) / F.sum(w)).alias("cx"), (F.sum(y * w) / F.sum(w)).alias("cy"), F.count(F.lit(1)).alias("n")
    ).where("n >= 3")
    df = shuffled(points).join(mid.drop("n"), CLUSTER)
    dx, dy = x - F.col("cx"), y - F.col("cy")
    cov = df.groupBy(*CLUSTER, "cx", "cy", "sw").agg(
        (F.sum(w * dx * dx) / F.first("sw")).alias("xx"), (F.sum(w * dx * dy) / F.first("sw")).alias("xy"), (F.sum(w * dy * dy) / F.first("sw")).alias("yy")
    )
    tr, det = F.col("xx") + F.col("yy"), F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    lam = tr / 2.0 + F.sqrt(F.greatest(tr * tr / 4.0 - det, F.lit(0.0)))
    tilt = F.abs("xy") > 1e-12
    px = lam - F.col("yy")
    norm = F.sqrt(px * px + F.col("xy") * F.col("xy"))
    flat = F.col("xx") >= F.col("yy")
    axis = cov.select(
        *CLUSTER, "cx", "cy", F.when(tilt, px / F.when(tilt, norm)).otherwise(F.when(flat, 1.0).otherwise(0.0)).alias("ux"),
        F.when(tilt, F.col("xy") / F.when(tilt, norm)).otherwise(F.when(flat, 0.0).otherwise(1.0)).alias("uy"),
    )
    t = (x - F.col("cx")) * F.col("ux") + (y - F.col("cy")) * F.col("uy")
    ends = shuffled(points).join(axis, CLUSTER).groupBy(*CLUSTER, "cx", "cy", "ux", "uy").agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    end = lambda c, u, s: round_half_away(F.col(c) + F.col(s) * F.col(u)).cast("int")
    return ends.select(
        *CLUSTER, end("cx", "ux", "t0").alias("x1"), end("cy", "uy", "t0").alias("y1"),
        end("cx", "ux", "t1").alias("x2"), end("cy", "uy", "t1").alias("y2"),
    )


def fit_arcs(points: DataFrame) -> DataFrame:
    """Circle through each cluster by centred least squares (>= 5 points).

    The radius satisfies the normal equations, r^2 = a^2 + b^2 + mean(u^2+v^2).
    The arc leaves out the largest gap between neighbouring angles on the circle
    (the first of equal ones): it begins at ``ts`` (-128 to 128 for a half turn
    either way) and ends at ``te >= ts``, beyond 128 where it crosses the cut.
    """
    x, y = F.col("x"), F.col("y")
    mid = points.groupBy(*CLUSTER).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    u, v = x - F.col("mx"), y - F.col("my")
    z = u * u + v * v
    m = shuffled(points).join(mid, CLUSTER).groupBy(*CLUSTER, "mx", "my").agg(
        F.avg(u * u).alias("uu"), F.avg(v * v).alias("vv"), F.avg(u * v).alias("uv"), F.avg(u * z).alias("uz"), F.avg(v * z).alias("vz"), F.avg(z).alias("z"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    ok = F.abs(det) >= 1e-12
    d = F.when(ok, det)
    a = (F.col("vv") * F.col("uz") - F.col("uv") * F.col("vz")) / 2.0 / d
    b = (F.col("uu") * F.col("vz") - F.col("uv") * F.col("uz")) / 2.0 / d
    m = m.where(ok).withColumns({"a": a, "b": b})
    m = m.select(
        *CLUSTER, (F.col("a") + F.col("mx")).alias("cxf"), (F.col("b") + F.col("my")).alias("cyf"),
        F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("z")).alias("rf"),
    )
    ext = _circular_extent(shuffled(points).join(m, CLUSTER).withColumn("_a", F.round(F.atan2(y - F.col("cyf"), x - F.col("cxf")), 9)), [*CLUSTER, "cxf", "cyf", "rf"])
    med = order_statistic(points, CLUSTER, "e", {"force": 0.5}).drop("n")
    code = lambda c: round_half_away(F.col(c) * 128.0 / math.pi).cast("int")
    whole = lambda c: round_half_away(F.col(c)).cast("long")  # nearly straight clusters have far centres
    return ext.join(med, CLUSTER).select(
        *CLUSTER, whole("cxf").alias("cx"), whole("cyf").alias("cy"), whole("rf").alias("radius"), code("a0").alias("ts"), code("a1").alias("te"), "force",
    )


def _circular_extent(points, keys, sectors=4096):
    """Arc that holds all angles ``_a`` of a group: its first angle a0 and its last one a1 >= a0.

    Angles are met sector by sector, so that no window holds a large cluster:
    gaps inside a sector are taken there, gaps between sectors from their ends.
    """
    sector = F.least(F.floor((F.col("_a") + math.pi) / (2 * math.pi) * sectors), F.lit(sectors - 1))
    df = points.select(*keys, "_a", sector.alias("_s"))
    df = df.withColumn("_before", F.lag("_a").over(Window.partitionBy(*keys, "_s").orderBy("_a")))
    # of equal gaps the one before the smallest angle
    gap = lambda before: F.struct(F.round(F.col("_a") - before, 9).alias("gap"), (-F.col("_a")).alias("first"), before.alias("last"))
    inner = F.when(F.col("_before").isNotNull(), gap(F.col("_before")))
    parts = df.groupBy(*keys, "_s").agg(F.min("_a").alias("_a"), F.max("_a").alias("_hi"), F.max(inner).alias("_in"))
    w = Window.partitionBy(*keys).orderBy("_s")
    around = F.last("_hi").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 2 * math.pi
    parts = parts.withColumn("_before", F.coalesce(F.lag("_hi").over(w), around))
    best = parts.withColumn("_g", F.greatest(gap(F.col("_before")), F.coalesce("_in", gap(F.col("_before"))))).groupBy(*keys).agg(F.max("_g").alias("_g"))
    return best.select(*keys, (-F.col("_g.first")).alias("a0"), (F.col("_g.last") + 2 * math.pi).alias("a1"))


def fit_primitives(points: DataFrame) -> DataFrame:
    """Best of segment and arc per cluster by estimated saving; unprofitable ones drop."""
    size = points.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("e") >= 2.0).alias("n_large"))
    osc = oscillation(points)
    amp = snap_to_levels(F.col("amp_raw"))
    phase = clamp(round_half_away(F.col("phase_raw") * 128.0 / math.pi), -128.0, 127.0).cast("int")
    osc = osc.select(*CLUSTER, amp.alias("amp"), phase.alias("phase")).where("amp <> 0")
    saved = F.col("n") * 0.6 * 2.0 + F.col("n_large") * 0.3 * 8.0
    names = ("x1", "y1", "x2", "y2", "cx", "cy", "radius", "ts", "te")
    parts = None
    for kind, cost, fit in (("segment", 88.0, fit_segments(points)), ("arc", 104.0, fit_arcs(points))):
        cols = [F.col(c) if c in fit.columns else F.lit(None).cast("int").alias(c) for c in names]
        one = fit.join(size, CLUSTER).select(*CLUSTER, F.lit(kind).alias("kind"), *cols, (saved - cost).alias("profit"))
        parts = one if parts is None else parts.unionByName(one)
    parts = parts.where("profit > 0").join(osc, CLUSTER)
    # On equal profit the segment wins.
    pick = F.struct("profit", F.when(F.col("kind") == "segment", 1).otherwise(0).alias("_seg"), "kind", *names, "amp", "phase")
    best = parts.groupBy(*CLUSTER).agg(F.max(pick).alias("p"))
    return best.select(*KEYS, F.col("comp").alias("prim_id"), *[F.col(f"p.{c}").alias(c) for c in ("kind", *names, "amp", "phase", "profit")])


def _band_weights(theta):
    """(lh, hl, hh) amplitude for a contour angle, linear between 5-degree entries."""
    deg = F.pmod(F.degrees(F.abs(theta)), F.lit(180.0))
    pos = F.when(deg > 90.0, 180.0 - deg).otherwise(deg) / 5.0
    i = F.least(F.floor(pos), F.lit(17)).cast("int")
    frac = pos - i
    out = []
    for table in (BAND_LH, BAND_HL, BAND_HH):
        t = F.array(*map(F.lit, table))
        out.append(F.element_at(t, i + 1) * (1.0 - frac) + F.element_at(t, i + 2) * frac)
    return out


def render_primitives(prims: DataFrame) -> DataFrame:
    """Band values that primitives predict, summed per cell (cells outside are kept).

    A segment's minor coordinate has a closed form along its major axis, so
    every step is independent.
    """
    osc = lambda i: F.col("amp") * F.sin(2.0 * math.pi * PHI_FREQ * i + F.col("phase") * (math.pi / 128.0))
    seg = prims.where("kind = 'segment'")
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    seg = seg.withColumns({"_dx": dx, "_dy": dy, "_i": F.explode(F.sequence(F.lit(0), F.greatest(dx, dy)))})
    i, adx, ady = F.col("_i"), F.col("_dx"), F.col("_dy")
    sx, sy = (F.when(F.col(b) > F.col(a), 1).otherwise(-1) for a, b in (("x1", "x2"), ("y1", "y2")))
    minor = lambda major, small: F.when(
        major > 0, F.floor((2 * i * small + major - 1) / (2 * F.when(major > 0, major)))
    ).otherwise(0)
    px = F.when(adx >= ady, F.col("x1") + sx * i).otherwise(F.col("x1") + sx * minor(ady, adx))
    py = F.when(adx >= ady, F.col("y1") + sy * minor(adx, ady)).otherwise(F.col("y1") + sy * i)
    theta = F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double"))
    seg = seg.select(*KEYS, py.cast("int").alias("y"), px.cast("int").alias("x"), osc(i).alias("f"), theta.alias("th"))

    arc = prims.where("kind = 'arc'").withColumns({
        "_ts": F.col("ts") * (math.pi / 128.0), "_te": F.col("te") * (math.pi / 128.0),
    })
    length = F.abs(F.col("_te") - F.col("_ts")) * F.col("radius")
    arc = arc.withColumn("_n", F.greatest(F.ceil(length * 2.0), F.lit(8)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("_ts") + (F.col("_te") - F.col("_ts")) * (i / F.col("_n"))
    arc = arc.select(
        *KEYS, round_half_away(F.col("cy") + F.col("radius") * F.sin(t)).cast("int").alias("y"),
        round_half_away(F.col("cx") + F.col("radius") * F.cos(t)).cast("int").alias("x"), osc(i).alias("f"), (t + math.pi / 2).alias("th"),
    )
    lh, hl, hh = _band_weights(F.col("th"))
    f = F.col("f")
    return seg.unionByName(arc).select(*PIXEL, (f * lh).alias("lh"), (f * hl).alias("hl"), (f * hh).alias("hh")).groupBy(*PIXEL).agg(
        F.sum("lh").alias("lh"), F.sum("hl").alias("hl"), F.sum("hh").alias("hh")
    )


def subtract(bands: DataFrame, rendered: DataFrame) -> DataFrame:
    r = rendered.select(*PIXEL, *[F.col(c).alias(f"_{c}") for c in ("lh", "hl", "hh")])
    return bands.join(shuffled(r), PIXEL, "left").select(
        *PIXEL, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in ("lh", "hl", "hh")]
    )


def _energy(bands, name):
    return bands.groupBy(*KEYS).agg(F.sum(F.col("lh") * F.col("lh") + F.col("hl") * F.col("hl") + F.col("hh") * F.col("hh")).alias(name))


def extract_iteratively(bands: DataFrame, max_passes=2):
    """Fit, render and subtract until over half the energy is explained.

    Returns (primitives with their pass, residual bands).  An image that has
    settled keeps its residual and leaves later passes; ``settled`` is false in
    the residual of images that ran out of passes.
    """
    active = cut_lineage(bands.select(*PIXEL, "lh", "hl", "hh"))
    start = _energy(active, "e0")
    found, done = None, None
    for n in range(max_passes):
        if active.isEmpty():
            break
        prims = cut_lineage(fit_primitives(cut_lineage(clusters(active))).withColumn("pass", F.lit(n)))
        found = prims if found is None else found.unionByName(prims)
        rest = cut_lineage(subtract(active, render_primitives(prims)))
        hit = prims.select(*KEYS).distinct()
        left = _energy(rest, "e1").join(start, IMAGE).join(hit, IMAGE, "left_semi")
        go_on = left.where((F.col("e0") > 0) & (1.0 - F.col("e1") / F.when(F.col("e0") > 0, F.col("e0")) <= 0.5)).select(*KEYS)
        stop = rest.join(go_on, IMAGE, "left_anti")
        done = stop if done is None else done.unionByName(stop)
        active = cut_lineage(rest.join(go_on, IMAGE, "left_semi"))
    active = active.withColumn("settled", F.lit(False))
    return found, (active if done is None else done.withColumn("settled", F.lit(True)).unionByName(active))


def ridge_components(field: DataFrame, threshold=RIDGE_THRESHOLD, min_cells=3) -> DataFrame:
    """Connected ridge cells that contain a local maximum.

    Each point carries the gradient magnitude and an orientation along the
    component's raster order, from its previous to its next point.
    """
    strong = with_extent(field).where(F.col("t") > threshold)
    comp = connected_components(strong.select(*PIXEL))
    seeds = local_maxima(field.select(*PIXEL, "t"), threshold, "t").join(shuffled(comp), PIXEL).select(*CLUSTER).distinct()
    size = comp.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    keep = seeds.join(size, CLUSTER)
    pts = comp.join(keep, CLUSTER).join(shuffled(strong.select(*PIXEL, "t", "grad", "w")), PIXEL)
    raster = F.col("y") * F.col("w").cast("long") + F.col("x")
    pts = dense_position(pts.withColumn("_o", raster), CLUSTER, "_o", "i").drop("_o", "w")
    return path_orientation(pts)


def path_orientation(points: DataFrame, chunk=1 << 16) -> DataFrame:
    """atan2 of next minus previous point along ``i``; end points use themselves."""
    home = F.floor(F.col("i") / chunk)
    off = F.col("i") % chunk
    ends = F.when(off == 0, F.array(home - 1, home)).when(off == chunk - 1, F.array(home, home + 1)).otherwise(F.array(home))
    df = points.withColumn("_c", F.explode(ends))
    w = Window.partitionBy(*CLUSTER, "_c").orderBy("i")
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    df = df.withColumn("orientation", F.atan2(dy.cast("double"), dx.cast("double")))
    return df.where(F.col("_c") == home).drop("_c")


def match_primitives(prims: DataFrame, contours: DataFrame, block_size=16) -> DataFrame:
    """Nearest contour of each primitive and its deltas, or Surprise.

    A contour is a candidate when one of its points lies within 4 cells of the
    primitive's centre; candidates are found through 4-cell bins, into which
    points are laid nine times and primitives once.  Its distance is the larger
    of the two end-point distances to any of its points.
    """
    s = block_size / 2.0
    seg = F.col("kind") == "segment"
    pos = lambda a, b: F.when(seg, F.col(a) / s).otherwise(b / s)
    p = prims.select(
        *KEYS, "prim_id", "kind", "amp",
        pos("y1", F.col("cy") - F.col("radius")).alias("ay"), pos("x1", F.col("cx")).alias("ax"),
        pos("y2", F.col("cy") + F.col("radius")).alias("by"), pos("x2", F.col("cx")).alias("bx"),
    )
    p = p.withColumns({"my": (F.col("ay") + F.col("by")) / 2.0, "mx": (F.col("ax") + F.col("bx")) / 2.0})
    cell = lambda c: F.floor(F.col(c) / MATCH_RADIUS)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    pb = p.withColumns({"_by": cell("my"), "_bx": cell("mx")})
    c = contours.select(*KEYS, "comp", "y", "x", "i", "orientation", "grad").withColumn("_by", around("y")).withColumn("_bx", around("x"))
    d2 = lambda yy, xx: (F.col("y") - F.col(yy)) * (F.col("y") - F.col(yy)) + (F.col("x") - F.col(xx)) * (F.col("x") - F.col(xx))
    gate = pb.join(shuffled(c), [*IMAGE, "_by", "_bx"]).withColumn("_d2", d2("my", "mx")).where(F.col("_d2") <= MATCH_RADIUS * MATCH_RADIUS)
    gate = gate.groupBy(*KEYS, "prim_id", "comp").agg(
        F.min(F.struct("_d2", "i", "y", "x", "orientation", "grad")).alias("near")
    )
    ends = gate.select(*KEYS, "prim_id", "comp").join(shuffled(p), [*IMAGE, "prim_id"]).join(
        shuffled(contours.select(*KEYS, "comp", "y", "x")), [*IMAGE, "comp"]
    ).groupBy(*KEYS, "prim_id", "comp").agg(F.sqrt(F.min(d2("ay", "ax"))).alias("_da"), F.sqrt(F.min(d2("by", "bx"))).alias("_db"))
    best = ends.join(shuffled(gate), [*IMAGE, "prim_id", "comp"]).groupBy(*KEYS, "prim_id").agg(
        F.min(F.struct(F.greatest("_da", "_db").alias("dist"), "comp", "near")).alias("b")
    ).where(F.col("b.dist") < MATCH_DISTANCE_MAX)
    df = p.join(shuffled(best), [*IMAGE, "prim_id"], "left")
    dy, dx = F.col("my") - F.col("b.near.y"), F.col("mx") - F.col("b.near.x")
    turn = angle_diff(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.col("b.near.orientation"))
    da = F.col("amp") - F.col("b.near.grad")
    close = (F.abs(dy) < MATCH_POS) & (F.abs(dx) < MATCH_POS) & (F.abs(turn) < MATCH_ANGLE) & (F.abs(da) < MATCH_AMP)
    code = lambda v, lo, hi: F.when(F.col("b").isNotNull(), clamp(round_half_away(v), float(lo), float(hi)).cast("int"))
    return df.select(
        *KEYS, "prim_id", F.when(F.col("b").isNull(), "Surprise").when(close, "Predicted").otherwise("Residual").alias("match"),
        F.col("b.comp").alias("comp"), F.col("b.dist").alias("dist"), code(dy * 16.0, -32768, 32767).alias("delta_y"), code(dx * 16.0, -32768, 32767).alias("delta_x"),
        code(turn * 32.0 / math.pi, -128, 127).alias("delta_angle"), code(da, -128, 127).alias("delta_amp"),
    )
