"""Connected structures, primitives, ridges, patches and augmentation."""

import math

from pyspark.sql import functions as F

from gridloom.catalog.base import Sql, add
from gridloom.constants import BAND_HH, BAND_HL, BAND_LH, LCG_MOD, LCG_MUL
from gridloom.operators import augment as au
from gridloom.operators import patches as pt
from gridloom.operators import paths
from gridloom.operators import stats as sx
from gridloom.operators import structure as gs
from gridloom.operators.saliency import saliency_field
from gridloom.session import cut_lineage

C = F.col
PX = "image_id ch y x"
CL = "image_id ch comp"


def _mask(c):
    return c.activity().where("v > 0").select(*PX.split())


def _mask_sql(q):
    return q.cte(f"SELECT {q.PX} FROM {q.activity()} WHERE v > 0")


add("mask_runs", lambda c: gs.mask_runs(c.ship().where("v > 25")),
    lambda q: q.cte(
        f"SELECT image_id, ch, y, min(x) AS x0, max(x) AS x1 FROM (SELECT {q.PX}, x - row_number() OVER (PARTITION BY image_id, ch, y ORDER BY x) AS g FROM {q.ship()} WHERE v > 25) GROUP BY image_id, ch, y, g"),
    "image_id ch y x0 x1")
add("connected_components", lambda c: gs.connected_components(_mask(c)), lambda q: q.components(_mask_sql(q)), PX + " comp")
add("connected_components_ship", lambda c: gs.connected_components(c.ship().where("v > 0").select(*PX.split())),
    lambda q: q.components(q.cte(f"SELECT {q.PX} FROM {q.ship()} WHERE v > 0")), PX + " comp")


def _bands(c):
    """Three detail bands per supplier from differences of neighbouring cells."""
    from gridloom.operators.stencil import forward_difference

    d = forward_difference(c.ship())
    return d.select(*PX.split(), (C("dy") / 8.0).alias("lh"), (C("dx") / 8.0).alias("hl"), ((C("dx") + C("dy")) / 8.0).alias("hh"))


def _bands_sql(q):
    return q.cte(f"SELECT {q.PX}, dy / 8.0 AS lh, dx / 8.0 AS hl, (dx + dy) / 8.0 AS hh FROM {q.fdiff(q.ship())}")


def _clusters_sql(q, bands=None, radius=2, least=13):
    e = q.cte(f"SELECT {q.PX}, abs(lh) + abs(hl) + abs(hh) AS e FROM {bands or _bands_sql(q)}")
    m = q.cte(f"SELECT *, (e > 0.5)::INT AS m FROM {e}")
    a = q.cte(f"SELECT *, max(m) OVER (PARTITION BY image_id, ch, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS a FROM {m}")
    g = q.cte(f"SELECT {q.PX} FROM (SELECT {q.PX}, max(a) OVER (PARTITION BY image_id, ch, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS g FROM {a}) WHERE g = 1")
    k = q.components(g)
    p = q.cte(f"SELECT {q.PX}, comp, e, count(*) OVER (PARTITION BY image_id, ch, comp) AS n_points FROM {m} JOIN {k} USING (image_id, ch, y, x) WHERE m = 1")
    return q.cte(f"SELECT *, row_number() OVER (PARTITION BY image_id, ch, comp ORDER BY y, x) - 1 AS i FROM {p} WHERE n_points >= {least}")


def _points(c):
    return cut_lineage(gs.clusters(_bands(c)))


# The SQL texts of the cluster queries walk whole components and are too slow on
# full tables; tests run them on a small fixture instead.


add("clusters", _points, None, PX + " comp i n_points", "e")


def _osc_sql(q, clusters=None):
    g = q.cte(f"SELECT image_id, ch, comp, sum(e * sin(2 * pi() * 0.30901699437494742::DOUBLE * i)) AS s, sum(e * cos(2 * pi() * 0.30901699437494742::DOUBLE * i)) AS c, count(*) AS n FROM {clusters or _clusters_sql(q)} GROUP BY ALL")
    return q.cte(f"SELECT image_id, ch, comp, sqrt(s * s + c * c) * 2.0 / n AS amp_raw, atan2(c, s) AS phase_raw FROM {g}")


add("oscillation", lambda c: gs.oscillation(_points(c)), None, CL, "amp_raw phase_raw")


def _seg_sql(q, clusters=None):
    p = clusters or _clusters_sql(q)
    a = q.cte(f"SELECT image_id, ch, comp, sum(greatest(e, 1e-9)) AS sw, sum(x * greatest(e, 1e-9)) / sum(greatest(e, 1e-9)) AS cx, sum(y * greatest(e, 1e-9)) / sum(greatest(e, 1e-9)) AS cy FROM {p} GROUP BY ALL HAVING count(*) >= 3")
    v = q.cte(f"SELECT image_id, ch, comp, cx, cy, sum(e * (x - cx) * (x - cx)) / any_value(sw) AS xx, sum(e * (x - cx) * (y - cy)) / any_value(sw) AS xy, sum(e * (y - cy) * (y - cy)) / any_value(sw) AS yy FROM {p} JOIN {a} USING (image_id, ch, comp) GROUP BY ALL")
    l = q.cte(f"SELECT *, (xx + yy) / 2.0 + sqrt(greatest((xx + yy) * (xx + yy) / 4.0 - (xx * yy - xy * xy), 0.0)) - yy AS px FROM {v}")
    d = q.cte(f"SELECT *, CASE WHEN abs(xy) > 1e-12 THEN px / sqrt(px * px + xy * xy) WHEN xx >= yy THEN 1.0 ELSE 0.0 END AS ux, CASE WHEN abs(xy) > 1e-12 THEN xy / sqrt(px * px + xy * xy) WHEN xx >= yy THEN 0.0 ELSE 1.0 END AS uy FROM {l}")
    t = q.cte(f"SELECT image_id, ch, comp, cx, cy, ux, uy, min((x - cx) * ux + (y - cy) * uy) AS t0, max((x - cx) * ux + (y - cy) * uy) AS t1 FROM {p} JOIN {d} USING (image_id, ch, comp) GROUP BY ALL")
    e = lambda c, u, s: Sql.rha(f"({c} + {s} * {u})")
    return q.cte(f"SELECT image_id, ch, comp, {e('cx', 'ux', 't0')} AS x1, {e('cy', 'uy', 't0')} AS y1, {e('cx', 'ux', 't1')} AS x2, {e('cy', 'uy', 't1')} AS y2 FROM {t}")


add("fit_segments", lambda c: gs.fit_segments(_points(c)), None, CL + " x1 y1 x2 y2")


def _arc_sql(q, clusters=None):
    p = clusters or _clusters_sql(q)
    a = q.cte(f"SELECT image_id, ch, comp, avg(x) AS mx, avg(y) AS my FROM {p} GROUP BY ALL HAVING count(*) >= 5")
    u = q.cte(f"SELECT image_id, ch, comp, mx, my, x, y, x - mx AS u, y - my AS v, power(x - mx, 2) + power(y - my, 2) AS z FROM {p} JOIN {a} USING (image_id, ch, comp)")
    m = q.cte(f"SELECT image_id, ch, comp, mx, my, avg(u * u) AS uu, avg(v * v) AS vv, avg(u * v) AS uv, avg(u * z) AS uz, avg(v * z) AS vz, avg(z) AS z FROM {u} GROUP BY ALL")
    s = q.cte(f"SELECT image_id, ch, comp, mx, my, z, (vv * uz - uv * vz) / 2.0 / (uu * vv - uv * uv) AS a, (uu * vz - uv * uz) / 2.0 / (uu * vv - uv * uv) AS b FROM {m} WHERE abs(uu * vv - uv * uv) >= 1e-12")
    r = q.cte(f"SELECT image_id, ch, comp, a + mx AS cxf, b + my AS cyf, sqrt(a * a + b * b + z) AS rf FROM {s} WHERE a * a + b * b + z >= 0")
    g = q.cte(f"SELECT image_id, ch, comp, cxf, cyf, rf, round(atan2(y - cyf, x - cxf), 9) AS a FROM {p} JOIN {r} USING (image_id, ch, comp)")
    g = q.cte(f"SELECT *, coalesce(lag(a) OVER w, last_value(a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 2 * pi()) AS b FROM {g} WINDOW w AS (PARTITION BY image_id, ch, comp ORDER BY a)")
    g = q.cte(f"SELECT *, row_number() OVER (PARTITION BY image_id, ch, comp ORDER BY round(a - b, 9) DESC, a) AS k FROM {g}")
    e = q.cte(f"SELECT image_id, ch, comp, cxf, cyf, rf, a AS a0, b + 2 * pi() AS a1 FROM {g} WHERE k = 1")
    f = q.stat(p, "e", {"force": 0.5}, "image_id, ch, comp")
    code = lambda c: f"{Sql.rha(f'({c} * 128.0 / pi())')}"
    return q.cte(f"SELECT image_id, ch, comp, {Sql.rha('cxf')} AS cx, {Sql.rha('cyf')} AS cy, {Sql.rha('rf')} AS radius, {code('a0')} AS ts, {code('a1')} AS te, force FROM {e} JOIN {f} USING (image_id, ch, comp)")


add("fit_arcs", lambda c: gs.fit_arcs(_points(c)), None, CL + " cx cy radius ts te", "force")


def _prims_sql(q, clusters=None):
    n = q.cte(f"SELECT image_id, ch, comp, count(*) * 0.6 * 2.0 + count(*) FILTER (e >= 2) * 0.3 * 8.0 AS saved FROM {clusters or _clusters_sql(q)} GROUP BY ALL")
    lv = "list_extract([1, 2, 3, 5, 8, 13, 21, 34], 1 + (amp_raw > 1.5)::INT + (amp_raw > 2.5)::INT + (amp_raw > 4)::INT + (amp_raw > 6.5)::INT + (amp_raw > 10.5)::INT + (amp_raw > 17)::INT + (amp_raw > 27.5)::INT)"
    o = q.cte(f"SELECT image_id, ch, comp, {lv} AS amp, least(greatest({Sql.rha('(phase_raw * 128.0 / pi())')}, -128), 127) AS phase FROM {_osc_sql(q, clusters)} WHERE amp_raw >= 0.5")
    # A segment costs less, so it always saves more than an arc of the same cluster.
    s = q.cte(f"SELECT s.*, saved - 88.0 AS profit FROM {_seg_sql(q, clusters)} s JOIN {n} USING (image_id, ch, comp) WHERE saved > 88.0")
    return q.cte(f"SELECT image_id, ch, comp AS prim_id, 'segment' AS kind, x1, y1, x2, y2, amp, phase, profit FROM {s} JOIN {o} USING (image_id, ch, comp)")


add("fit_primitives", lambda c: gs.fit_primitives(_points(c)), None, "image_id ch prim_id x1 y1 x2 y2 amp phase", "profit", "kind")


# ---- the same on quantised details, where an image has several components ------

DETAIL = 200.0  # step of the quantised differences
NEAR, LEAST = 1, 4  # cells that join, points of a cluster


def _details(c):
    """Detail bands of every image: neighbour differences on a quantiser's levels."""
    from gridloom.functions.quant import deadzone_quantize
    from gridloom.operators.stencil import forward_difference

    level = lambda v: deadzone_quantize(v, F.lit(DETAIL), F.lit(0.22)) * (DETAIL / 32.0)
    d = forward_difference(c.plane())
    return d.select(*PX.split(), level(C("dy")).alias("lh"), level(C("dx")).alias("hl"), level(C("dx") + C("dy")).alias("hh"))


def _details_sql(q):
    level = lambda e: f"{q.deadzone(e, f'{DETAIL}::DOUBLE', '0.22::DOUBLE')} * ({DETAIL}::DOUBLE / 32.0)"
    return q.cte(f"SELECT {q.PX}, {level('dy')} AS lh, {level('dx')} AS hl, {level('(dx + dy)')} AS hh FROM {q.fdiff(q.plane())}")


def _detail_points(c):
    return cut_lineage(gs.clusters(_details(c), radius=NEAR, least_points=LEAST))


def _detail_clusters_sql(q):
    return _clusters_sql(q, _details_sql(q), NEAR, LEAST)


add("detail_clusters", _detail_points, _detail_clusters_sql, PX + " comp i n_points", "e")
add("detail_oscillation", lambda c: gs.oscillation(_detail_points(c)), lambda q: _osc_sql(q, _detail_clusters_sql(q)), CL, "amp_raw phase_raw")
add("detail_segments", lambda c: gs.fit_segments(_detail_points(c)), lambda q: _seg_sql(q, _detail_clusters_sql(q)), CL + " x1 y1 x2 y2")
add("detail_arcs", lambda c: gs.fit_arcs(_detail_points(c)), lambda q: _arc_sql(q, _detail_clusters_sql(q)), CL + " cx cy radius ts te", "force")
add("detail_primitives", lambda c: gs.fit_primitives(_detail_points(c)), lambda q: _prims_sql(q, _detail_clusters_sql(q)), "image_id ch prim_id x1 y1 x2 y2 amp phase", "profit", "kind")


def _line_prims(c):
    """Segments and arcs with coordinates read off orders."""
    o = c.table("orders")
    k = C("o_orderkey")
    return o.select(
        (C("o_custkey") % 7).alias("image_id"), F.lit(0).alias("ch"), k.alias("prim_id"), F.when(k % 3 == 0, "arc").otherwise("segment").alias("kind"),
        (k % 61).cast("int").alias("x1"), (k * 7 % 53).cast("int").alias("y1"), (C("o_custkey") * 3 % 67).cast("int").alias("x2"), (C("o_custkey") * 5 % 59).cast("int").alias("y2"),
        (k % 41).cast("int").alias("cx"), (k * 3 % 43).cast("int").alias("cy"), (k % 13 + 2).cast("int").alias("radius"), (k % 97 - 100).cast("int").alias("ts"), (k % 31 + 20).cast("int").alias("te"),
        (k % 5 + 1).cast("int").alias("amp"), (k % 100 - 50).cast("int").alias("phase"),
    )


def _render_sql(q):
    k = "o_orderkey"
    p = q.cte(
        f"SELECT o_custkey % 7 AS image_id, 0 AS ch, {k} AS prim_id, {k} % 3 = 0 AS arc, {k} % 61 AS x1, {k} * 7 % 53 AS y1, o_custkey * 3 % 67 AS x2, o_custkey * 5 % 59 AS y2, {k} % 41 AS cx, {k} * 3 % 43 AS cy, "
        f"{k} % 13 + 2 AS radius, ({k} % 97 - 100) * pi() / 128 AS ts, ({k} % 31 + 20) * pi() / 128 AS te, {k} % 5 + 1 AS amp, {k} % 100 - 50 AS phase FROM orders")
    s = q.cte(f"SELECT *, abs(x2 - x1) AS dx, abs(y2 - y1) AS dy, CASE WHEN x2 > x1 THEN 1 ELSE -1 END AS sx, CASE WHEN y2 > y1 THEN 1 ELSE -1 END AS sy, unnest(range(greatest(abs(x2 - x1), abs(y2 - y1)) + 1)) AS i FROM {p} WHERE NOT arc")
    s = q.cte(
        f"SELECT image_id, ch, CASE WHEN dx >= dy THEN y1 + sy * CASE WHEN dx > 0 THEN floor((2 * i * dy + dx - 1) / (2 * dx)) ELSE 0 END ELSE y1 + sy * i END AS y, CASE WHEN dx >= dy THEN x1 + sx * i ELSE x1 + sx * floor((2 * i * dx + dy - 1) / (2 * dy)) END AS x, "
        f"amp, phase, i, atan2(y2 - y1, x2 - x1) AS th FROM {s}")
    a = q.cte(f"SELECT *, least(greatest(ceil(abs(te - ts) * radius * 2.0), 8), 2000)::BIGINT AS n FROM {p} WHERE arc")
    a = q.cte(f"SELECT *, ts + (te - ts) * (i / n::DOUBLE) AS t FROM (SELECT *, unnest(range(n + 1)) AS i FROM {a})")
    a = q.cte(f"SELECT image_id, ch, {Sql.rha('(cy + radius * sin(t))')} AS y, {Sql.rha('(cx + radius * cos(t))')} AS x, amp, phase, i, t + pi() / 2 AS th FROM {a}")
    u = q.cte(f"SELECT image_id, ch, y, x, amp * sin(2 * pi() * 0.30901699437494742::DOUBLE * i + phase * pi() / 128) AS f, degrees(abs(th)) % 180.0::DOUBLE AS d FROM (SELECT * FROM {s} UNION ALL SELECT * FROM {a})")
    v = q.cte(f"SELECT *, least(floor(p)::BIGINT, 17) AS k, p - least(floor(p), 17) AS fr FROM (SELECT *, CASE WHEN d > 90 THEN 180.0 - d ELSE d END / 5.0 AS p FROM {u})")
    w = lambda t: f"sum(f * ({list(t)}[k + 1] * (1.0 - fr) + {list(t)}[k + 2] * fr))"
    return q.cte(f"SELECT image_id, ch, y, x, {w(BAND_LH)} AS lh, {w(BAND_HL)} AS hl, {w(BAND_HH)} AS hh FROM {v} GROUP BY image_id, ch, y, x")


add("render_primitives", lambda c: gs.render_primitives(_line_prims(c)), _render_sql, PX, "lh hl hh")
add("subtract_rendered", lambda c: gs.subtract(_bands(c), gs.render_primitives(_line_prims(c))),
    lambda q: q.cte(f"SELECT b.image_id, b.ch, b.y, b.x, b.lh - coalesce(r.lh, 0.0) AS lh, b.hl - coalesce(r.hl, 0.0) AS hl, b.hh - coalesce(r.hh, 0.0) AS hh FROM {_bands_sql(q)} b LEFT JOIN {_render_sql(q)} r USING (image_id, ch, y, x)"), PX, "lh hl hh")
add("extract_iteratively", lambda c: gs.extract_iteratively(_bands(c), 2)[0], None, "image_id ch prim_id pass x1 y1 x2 y2 amp phase", "profit", "kind")
add("extract_residual", lambda c: gs.extract_iteratively(_bands(c), 2)[1], None, PX, "lh hl hh", bools="settled")

# ---- ridges and matching ---------------------------------------------------


def _field(c):
    f = cut_lineage(saliency_field(sx.block_mean(c.ship(), 3)))
    return f.withColumns({"t": F.round("t", 9), "grad": F.round("grad", 9)})


def _field_sql(q):
    return q.cte(f"SELECT {q.PX}, round(t, 9) AS t, round(grad, 9) AS grad FROM {q.field(q.block_mean(q.ship(), 3))}")


def _ridge_sql(q, threshold=0.3):
    f = _field_sql(q)
    s = q.cte(f"SELECT * FROM {f} WHERE t > {threshold}")
    k = q.components(s)
    nine = ", ".join(f"n{i}{j}" for i in range(3) for j in range(3))
    seed = q.cte(f"SELECT DISTINCT image_id, ch, comp FROM (SELECT {q.PX} FROM {q.ring(f, 't')} WHERE t > {threshold} AND t >= greatest({nine})) JOIN {k} USING (image_id, ch, y, x)")
    n = q.cte(f"SELECT image_id, ch, comp, count(*) AS n FROM {k} GROUP BY ALL HAVING count(*) >= 3")
    p = q.cte(f"SELECT k.*, n, t, grad, row_number() OVER (PARTITION BY image_id, ch, comp ORDER BY y, x) - 1 AS i FROM {k} k JOIN {seed} USING (image_id, ch, comp) JOIN {n} USING (image_id, ch, comp) JOIN {s} USING (image_id, ch, y, x)")
    w = "OVER (PARTITION BY image_id, ch, comp ORDER BY i)"
    return q.cte(f"SELECT *, atan2(coalesce(lead(y) {w}, y) - coalesce(lag(y) {w}, y), coalesce(lead(x) {w}, x) - coalesce(lag(x) {w}, x)) AS orientation FROM {p}")


def _ridges(c):
    return gs.ridge_components(_field(c), 0.3)


add("ridge_components", _ridges, _ridge_sql, PX + " comp i n", "t grad orientation")


def _plane_field(c):
    f = cut_lineage(saliency_field(c.plane()))
    return f.withColumns({"t": F.round("t", 9), "grad": F.round("grad", 9)})


def _paths_sql(q, threshold=0.15, longest=2560):
    """Every walk step by step; no walk has more steps than its image has states."""
    f = q.cte(f"SELECT {q.PX}, round(t, 9) AS t, round(grad, 9) AS grad FROM {q.field(q.plane())}")
    g = q.cte(
        f"SELECT *, sqrt(gx * gx + gy * gy) AS len FROM (SELECT {q.PX}, t, grad, (coalesce(n21, t) - coalesce(n01, t)) / CASE WHEN n21 IS NOT NULL AND n01 IS NOT NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS gy, "
        f"(coalesce(n12, t) - coalesce(n10, t)) / CASE WHEN n12 IS NOT NULL AND n10 IS NOT NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS gx, "
        f"t >= greatest({', '.join(f'n{i}{j}' for i in range(3) for j in range(3))}) AS peak FROM {q.ring(f, 't')})")
    p = q.cte(f"SELECT image_id, ch, y, x, y * 40 + x AS id, t, grad, peak, CASE WHEN len >= 1e-12 THEN -gx / len END AS dy, CASE WHEN len >= 1e-12 THEN gy / len END AS dx FROM {g} WHERE t >= {threshold}")
    s = q.cte(
        f"SELECT a.image_id, a.ch, a.id * 2 + s AS state, b.id * 2 + CASE WHEN coalesce(a.dy * b.dy + a.dx * b.dx, 0.0) < 0 THEN 1 - s ELSE s END AS nxt FROM {p} a CROSS JOIN (VALUES (0), (1)) AS h(s) "
        f"JOIN {p} b ON b.image_id = a.image_id AND b.ch = a.ch AND b.y = a.y + {Sql.rha('(a.dy * (1 - 2 * s))')} AND b.x = a.x + {Sql.rha('(a.dx * (1 - 2 * s))')}")
    seed = q.cte(f"SELECT image_id, ch, id FROM {p} WHERE peak AND t > {threshold}")
    w = q.cte(
        f"SELECT image_id, ch, id * 2 AS walk, id * 2 AS state, 0 AS dist FROM {seed} UNION ALL SELECT image_id, ch, id * 2 + 1, nxt, 1 FROM {seed} JOIN {s} USING (image_id, ch) WHERE state = id * 2 + 1 "
        f"UNION ALL SELECT r.image_id, r.ch, r.walk, e.nxt, r.dist + 1 FROM @self r JOIN {s} e ON e.image_id = r.image_id AND e.ch = r.ch AND e.state = r.state WHERE r.dist < {longest}", "walks", True)
    r = q.cte(f"SELECT image_id, ch, state, state // 2 AS id, min(walk * 10000 + dist) AS own FROM {w} GROUP BY ALL")
    m = q.cte(f"SELECT *, own // 10000 AS walk, own % 10000 AS dist, state = arg_min(state, own * 10000 + state) OVER (PARTITION BY image_id, ch, id) AS mine FROM {r}")
    e = q.cte(f"SELECT image_id, ch, walk, coalesce(min(dist) FILTER (NOT mine), 100000) AS stop, coalesce(bool_or(mine AND dist = 0), false) AS begun FROM {m} GROUP BY ALL")
    k = q.cte(
        f"SELECT m.image_id, m.ch, m.walk // 2 AS comp, id, CASE WHEN m.walk % 2 = 1 THEN -dist ELSE dist END AS o FROM {m} m JOIN {e} e ON e.image_id = m.image_id AND e.ch = m.ch AND e.walk = m.walk AND m.dist < e.stop "
        f"WHERE mine AND EXISTS (SELECT 1 FROM {e} b WHERE b.image_id = m.image_id AND b.ch = m.ch AND b.walk = m.walk - m.walk % 2 AND b.begun)")
    k = q.cte(f"SELECT *, o - min(o) OVER c AS i, count(*) OVER c AS n FROM {k} WINDOW c AS (PARTITION BY image_id, ch, comp)")
    k = q.cte(f"SELECT image_id, ch, comp, i, n, y, x, t, grad FROM {k} JOIN {p} USING (image_id, ch, id) WHERE n >= 3")
    o = "OVER (PARTITION BY image_id, ch, comp ORDER BY i)"
    return q.cte(f"SELECT *, atan2(coalesce(lead(y) {o}, y) - coalesce(lag(y) {o}, y), coalesce(lead(x) {o}, x) - coalesce(lag(x) {o}, x)) AS orientation FROM {k}")


add("ridge_paths", lambda c: paths.ridge_paths(_plane_field(c)), _paths_sql, PX + " comp i n", "t grad orientation")


def _near_prims(c):
    """Primitives in block coordinates, one set per supplier, from line items."""
    li = c.table("lineitem").dropDuplicates(["l_suppkey", "l_orderkey"]).select(C("l_suppkey").alias("image_id"), "l_orderkey")
    k = C("l_orderkey")
    return li.select(
        "image_id", F.lit(0).alias("ch"), k.alias("prim_id"), F.when(k % 4 == 0, "arc").otherwise("segment").alias("kind"), (k % 80).cast("int").alias("x1"), (k * 11 % 200).cast("int").alias("y1"),
        (k % 80 + k % 9).cast("int").alias("x2"), (k * 11 % 200 + k % 5 * 4).cast("int").alias("y2"), (k % 77).cast("int").alias("cx"), (k * 13 % 190).cast("int").alias("cy"), (k % 8).cast("int").alias("radius"), (k % 34).cast("int").alias("amp"),
    )


def _match_sql(q):
    k = "l_orderkey"
    p = q.cte(
        f"SELECT l_suppkey AS image_id, {k} AS prim_id, {k} % 34 AS amp, CASE WHEN {k} % 4 = 0 THEN {k} * 13 % 190 - {k} % 8 ELSE {k} * 11 % 200 END / 8.0::DOUBLE AS ay, CASE WHEN {k} % 4 = 0 THEN {k} % 77 ELSE {k} % 80 END / 8.0::DOUBLE AS ax, "
        f"CASE WHEN {k} % 4 = 0 THEN {k} * 13 % 190 + {k} % 8 ELSE {k} * 11 % 200 + {k} % 5 * 4 END / 8.0::DOUBLE AS by_, CASE WHEN {k} % 4 = 0 THEN {k} % 77 ELSE {k} % 80 + {k} % 9 END / 8.0::DOUBLE AS bx FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)")
    p = q.cte(f"SELECT *, (ay + by_) / 2 AS my, (ax + bx) / 2 AS mx FROM {p}")
    r = _ridge_sql(q)
    g = q.cte(
        f"SELECT p.image_id, prim_id, comp, min(power(y - my, 2) + power(x - mx, 2)) AS dm, sqrt(min(power(y - ay, 2) + power(x - ax, 2))) AS da, sqrt(min(power(y - by_, 2) + power(x - bx, 2))) AS db, "
        f"arg_min(struct_pack(y := y, x := x, o := orientation, g := grad), (power(y - my, 2) + power(x - mx, 2)) * 1000 + i * 1e-6) AS nr FROM {p} p JOIN {r} r USING (image_id) GROUP BY ALL")
    b = q.cte(f"SELECT * FROM (SELECT *, greatest(da, db) AS dist, row_number() OVER (PARTITION BY image_id, prim_id ORDER BY greatest(da, db), comp) AS rn FROM {g} WHERE dm <= 16) WHERE rn = 1 AND dist < 2")
    d = q.cte(f"SELECT p.image_id, p.prim_id, p.amp, b.comp, b.dist, my - nr.y AS dy, mx - nr.x AS dx, atan2(by_ - ay, bx - ax) - nr.o + pi() AS tr, amp - nr.g AS dam FROM {p} p LEFT JOIN {b} b USING (image_id, prim_id)")
    d = q.cte(f"SELECT *, tr - floor(tr / (2 * pi())) * 2 * pi() - pi() AS da FROM {d}")
    code = lambda e, lo, hi: f"least(greatest({Sql.rha(e)}, {lo}), {hi})"
    nul = lambda e: f"CASE WHEN comp IS NULL THEN NULL ELSE {e} END"
    return q.cte(
        f"SELECT image_id, 0 AS ch, prim_id, CASE WHEN comp IS NULL THEN 'Surprise' WHEN abs(dy) < 0.5 AND abs(dx) < 0.5 AND abs(da) < 0.392699 AND abs(dam) < 2 THEN 'Predicted' ELSE 'Residual' END AS match, comp, dist, "
        f"{nul(code('(dy * 16.0)', -32768, 32767))} AS delta_y, {nul(code('(dx * 16.0)', -32768, 32767))} AS delta_x, {nul(code('(da * 32.0 / pi())', -128, 127))} AS delta_angle, {nul(code('dam', -128, 127))} AS delta_amp FROM {d}")


add("match_primitives", lambda c: gs.match_primitives(_near_prims(c), cut_lineage(_ridges(c))), _match_sql,
    "image_id ch prim_id comp delta_y delta_x delta_angle delta_amp", "dist", "match")

# ---- patches ---------------------------------------------------------------
def _tile_fits(q, px):
    """Fits of tiles by the orthogonal basis of a whole grid: 1, f, g, fg, f2, g2 (centred coordinates and centred squares)."""
    p = "image_id, ch, x0, y0, pw, ph"
    c = q.cte(f"SELECT *, px / (pw - 1.0::DOUBLE) - 0.5 AS f, py / (ph - 1.0::DOUBLE) - 0.5 AS g, (pw + 1) / (12.0::DOUBLE * (pw - 1)) AS fm, (ph + 1) / (12.0::DOUBLE * (ph - 1)) AS gm FROM {px}")
    c = q.cte(f"SELECT *, f * f - fm AS f2, g * g - gm AS g2 FROM {c}")
    on = lambda e: f"sum(v * {e}) / sum({e} * {e})"
    k = q.cte(f"SELECT {p}, any_value(fm) AS fm, any_value(gm) AS gm, avg(v) AS c0, {on('f')} AS cf, {on('g')} AS cg, {on('(f * g)')} AS cfg, {on('f2')} AS cf2, {on('g2')} AS cg2 FROM {c} GROUP BY {p}")
    r = q.cte(f"SELECT {p}, sqrt(avg(power(v - (c0 + cf * f + cg * g + cfg * f * g + cf2 * f2 + cg2 * g2), 2))) AS rmse FROM {c} JOIN {k} USING ({p}) GROUP BY {p}")
    return q.cte(
        f"SELECT {p}, rmse, c0 - cf / 2 - cg / 2 + cfg / 4 + cf2 * (0.25 - fm) + cg2 * (0.25 - gm) AS a00, cf - cf2 - cfg / 2 AS a10, cg - cg2 - cfg / 2 AS a01, cfg AS a11, cf2 AS a20, cg2 AS a02 FROM {k} JOIN {r} USING ({p})")


def _patches_sql(q, step=30.0):
    s = q.ship()
    px = q.cte(f"SELECT image_id, ch, v, x // 16 * 16 AS x0, y // 16 * 16 AS y0, least(16, w - x // 16 * 16) AS pw, least(16, h - y // 16 * 16) AS ph, x % 16 AS px, y % 16 AS py FROM {s} JOIN {q.extent(s)} USING (image_id, ch)")
    whole = _tile_fits(q, px)
    split = f"rmse > {step / 2} AND pw >= 8 AND ph >= 8"
    parts = q.cte(
        f"SELECT image_id, ch, v, x0 + r * (pw // 2) AS x0, y0 + l * (ph // 2) AS y0, CASE r WHEN 1 THEN pw - pw // 2 ELSE pw // 2 END AS pw, CASE l WHEN 1 THEN ph - ph // 2 ELSE ph // 2 END AS ph, px - r * (pw // 2) AS px, py - l * (ph // 2) AS py "
        f"FROM (SELECT p.*, (px >= pw // 2)::INT AS r, (py >= ph // 2)::INT AS l FROM {px} p SEMI JOIN (SELECT * FROM {whole} WHERE {split}) t USING (image_id, ch, x0, y0))")
    return q.cte(f"SELECT * FROM {whole} WHERE NOT ({split}) UNION ALL SELECT * FROM {_tile_fits(q, parts)}")


add("fit_patches", lambda c: pt.fit_patches(c.ship(), 30.0), _patches_sql, "image_id ch x0 y0 pw ph", "rmse a00 a10 a01 a11 a20 a02", digits=8)
add("render_patches", lambda c: pt.render_patches(pt.fit_patches(c.ship(), 30.0)),
    lambda q: q.cte(
        "SELECT image_id, ch, y0 + py AS y, x0 + px AS x, a00 + a10 * f + a01 * g + a11 * f * g + a20 * f * f + a02 * g * g AS v FROM "
        f"(SELECT *, CASE WHEN pw > 1 THEN px / (pw - 1.0::DOUBLE) ELSE 0.0 END AS f, CASE WHEN ph > 1 THEN py / (ph - 1.0::DOUBLE) ELSE 0.0 END AS g FROM (SELECT *, unnest(range(pw)) AS px FROM (SELECT *, unnest(range(ph)) AS py FROM {_patches_sql(q)})))"),
    PX, "v", digits=8)

# ---- augmentation ----------------------------------------------------------


def draw_sql(seed, stream, *items):
    s = f"({seed * 7919 + stream * 104729 + 1})::BIGINT"
    for i in items:
        s = f"((({s} + ({i})::BIGINT + 1) * {LCG_MUL}) % {LCG_MOD})"
    return f"({s} * {LCG_MUL} % {LCG_MOD})"


def below_sql(limit, *args):
    return f"({draw_sql(*args)} // 8) % greatest({limit}, 1)"


add("severity", lambda c: c.table("supplier").select(C("s_suppkey").alias("id"), *[e.alias(n) for n, e in au.severity((C("s_suppkey") % 101).cast("double")).items()]),
    lambda q: q.cte("SELECT s_suppkey AS id, " + ", ".join(f"greatest(({l}.0 - s_suppkey % 101) / {l}.0, 0.0) AS {n}" for n, l in (("zero", 80), ("swap", 60), ("shift", 45), ("freeze", 30), ("noise", 15))) + " FROM supplier"),
    "id", "zero swap shift freeze noise")
add("zero_blocks", lambda c: au.zero_blocks(c.plane(), 0.8, 7, 8),
    lambda q: q.cte(f"SELECT {q.PX}, CASE WHEN {below_sql(10000, 7, 30, 'image_id', 'y // 8', 'x // 8')} < 3200 THEN 0.0 ELSE v END AS v FROM {q.plane()}"), PX, "v")


def _bands_of(q, seed, stream, n, high, reach=None):
    b = q.cte(f"SELECT DISTINCT image_id, unnest(range(1, {n} + 1)) AS item FROM {q.pixels()}")
    sh = f", {below_sql(2 * reach + 1, seed, stream + 2, 'image_id', 'item')} - {reach} AS shift" if reach is not None else ""
    b = q.cte(f"SELECT *, {below_sql(32, seed, stream, 'image_id', 'item')} AS y0{sh} FROM {b}")
    return q.cte(f"SELECT *, least(y0 + {high[0]} + {below_sql(high[1], seed, stream + 1, 'image_id', 'item')}, 32) AS y1 FROM {b}")


def _swap_sql(q):
    b = _bands_of(q, 7, 40, 4, (4, 16))
    p = q.cte(f"SELECT image_id, y, x, c1, c2, (SELECT count(*) FROM {b} b WHERE b.image_id = p.image_id AND p.y >= b.y0 AND p.y < b.y1) % 2 = 1 AS odd FROM {q.chroma()} p")
    return q.cte(f"SELECT image_id, y, x, CASE WHEN odd THEN c2 ELSE c1 END AS c1, CASE WHEN odd THEN c1 ELSE c2 END AS c2 FROM {p}")


add("swap_channels", lambda c: au.swap_channels(c.chroma(), 0.8, 7), _swap_sql, "image_id y x", "c1 c2")


def _shift_sql(q):
    b = _bands_of(q, 7, 50, 4, (1, 12), 6)
    p = q.cte(f"SELECT image_id, y, x, r, g, b, coalesce((SELECT sum(shift) FROM {b} b WHERE b.image_id = p.image_id AND p.y >= b.y0 AND p.y < b.y1), 0)::BIGINT AS s FROM {q.pixels()} p")
    return q.cte(f"SELECT image_id, y, ((x + s) % 40 + 40) % 40 AS x, r, g, b FROM {p}")


add("shift_rows", lambda c: au.shift_rows(c.pixels(), 1.0, 7), _shift_sql, "image_id y x r g b")


def _shift_plane_sql(q):
    """Bands as for pixels, on the extent of the plane: a tenth as many as it has rows, shifted by up to a tenth of its width."""
    a = q.activity()
    i = ("image_id", "item")
    b = q.cte(f"SELECT *, unnest(range(1, n + 1)) AS item FROM (SELECT image_id, h, w, greatest(round(h * 0.1::DOUBLE), 1)::BIGINT AS n, floor(w * 0.1::DOUBLE)::BIGINT AS reach FROM {q.extent(a)})")
    b = q.cte(f"SELECT *, {below_sql('h', 3, 50, *i)} AS y0, {below_sql('2 * reach + 1', 3, 52, *i)} - reach AS shift FROM {b}")
    b = q.cte(f"SELECT image_id, shift, unnest(range(y0, least(y0 + 2 + {below_sql(8, 3, 51, *i)}, h))) AS y FROM {b}")
    s = q.cte(f"SELECT image_id, y, sum(shift)::BIGINT AS s FROM {b} GROUP BY ALL")
    return q.cte(f"SELECT image_id, ch, y, ((x + coalesce(s, 0)) % w + w) % w AS x, v FROM {a} JOIN {q.extent(a)} USING (image_id, ch) LEFT JOIN {s} USING (image_id, y)")


add("shift_plane", lambda c: au.shift_plane(c.activity(), 1.0, 3), _shift_plane_sql, PX, "v")


def _rects_of(q, seed, stream, n, wide, high):
    b = q.cte(f"SELECT DISTINCT image_id, unnest(range(1, {n} + 1)) AS item FROM {q.pixels()}")
    i = ("image_id", "item")
    b = q.cte(f"SELECT *, {below_sql(40, seed, stream, *i)} AS x0, {below_sql(32, seed, stream + 1, *i)} AS y0 FROM {b}")
    b = q.cte(f"SELECT *, least(x0 + {wide[0]} + {below_sql(wide[1], seed, stream + 2, *i)}, 40) AS x1, least(y0 + {high[0]} + {below_sql(high[1], seed, stream + 3, *i)}, 32) AS y1 FROM {b}")
    cells = q.cte(f"SELECT image_id, item, y, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM {b})")
    return q.cte(f"SELECT image_id, y, x, r, g, b, item FROM {q.pixels()} JOIN {cells} USING (image_id, y, x)")


def _paint_sql(q, painted):
    l = q.cte(f"SELECT image_id, y, x, arg_max(r, item) AS r, arg_max(g, item) AS g, arg_max(b, item) AS b FROM {painted} GROUP BY image_id, y, x")
    return q.cte(f"SELECT p.image_id, p.y, p.x, coalesce(l.r, p.r) AS r, coalesce(l.g, p.g) AS g, coalesce(l.b, p.b) AS b FROM {q.pixels()} p LEFT JOIN {l} l USING (image_id, y, x)")


def _freeze_sql(q):
    z = _rects_of(q, 7, 10, 3, (4, 12), (4, 12))
    t = lambda c, k: f"least(greatest(floor(avg({c})) + {below_sql(41, 7, 20 + k, 'image_id', 'item')} - 20, 0), 255) AS {c}"
    m = q.cte(f"SELECT image_id, item, {t('r', 0)}, {t('g', 1)}, {t('b', 2)} FROM {z} GROUP BY image_id, item")
    return _paint_sql(q, q.cte(f"SELECT z.image_id, z.y, z.x, item, m.r, m.g, m.b FROM {z} z JOIN {m} m USING (image_id, item)"))


add("freeze_blocks", lambda c: au.freeze_blocks(c.pixels(), 1.0, 7, (4, 12), count=3), _freeze_sql, "image_id y x r g b")


def _noise_sql(q):
    z = _rects_of(q, 7, 60, 1, (4, 32), (1, 8))
    k = q.cte(f"SELECT image_id, y, x, item, {below_sql(5, 7, 70, 'image_id', 'item')} AS k FROM {z}")
    v = lambda ch: f"least(greatest({[p[ch] for p in au.PATCH_COLORS]}[k + 1] + {below_sql(80, 7, 71 + ch, 'image_id', 'item', 'y', 'x')} - 40, 0), 255) AS {'rgb'[ch]}"
    return _paint_sql(q, q.cte(f"SELECT image_id, y, x, item, {v(0)}, {v(1)}, {v(2)} FROM {k}"))


add("noise_patches", lambda c: au.noise_patches(c.pixels(), 1.0, 7), _noise_sql, "image_id y x r g b")
