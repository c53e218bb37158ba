"""Block transforms, variable sizes, quantisation, channel prediction, the flagship study."""

from pyspark.sql import functions as F

from gridloom.catalog.base import Sql, add
from gridloom.catalog.pointwise import SURF
from gridloom.functions.quant import rate_bits
from gridloom.operators import blocks as bl
from gridloom.operators import quality as ql
from gridloom.operators import stats as sx
from gridloom.operators.saliency import lookup_field, saliency_field, with_strength
from gridloom.operators.sequences import top_energy
from gridloom.plans.codec import color_planes, reconstruct
from gridloom.plans.rate_distortion import QUALITIES, block_facts, mean_grid, rd_points, steps_per_quality
from gridloom.tiling import with_extent

C = F.col
PX = "image_id ch y x"
BK = "image_id ch gy gx"

add("dct_blocks", lambda c: bl.coefficients(bl.block_analyze(c.plane(), 8)), lambda q: q.dct(q.plane(), 8), BK + " u w", "c")
add("dct_relational", lambda c: bl.dct_relational(c.plane(), 8), lambda q: q.dct(q.plane(), 8), BK + " u w", "c")


def _mirrored(q, src, bs, overlap):
    """Mirror-extended block pixels: (image_id, ch, gy, gx, r, i, v)."""
    e = q.extent(src)
    stride, off = (bs // 2, bs // 2) if overlap else (bs, 0)
    m = lambda p, n: f"(CASE WHEN (({p}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) >= {n} THEN 2 * ({n} - 1) - (({p}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) ELSE (({p}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) END)"
    t = q.cte(
        f"SELECT image_id, ch, gy, gx, r, i, {m(f'gy * {stride} - {off} + r', 'h')} AS y, {m(f'gx * {stride} - {off} + i', 'w')} AS x FROM {e}, "
        f"unnest(range((h + {stride} - 1) // {stride})) AS a(gy), unnest(range((w + {stride} - 1) // {stride})) AS b(gx), unnest(range({bs})) AS c(r), unnest(range({bs})) AS d(i)")
    win = f" * sin(pi() * (r + 0.5) / {bs}) * sin(pi() * (i + 0.5) / {bs})" if overlap else ""
    return q.cte(f"SELECT t.image_id, t.ch, gy, gx, r, i, v{win} AS v FROM {t} t JOIN {src} s ON s.image_id = t.image_id AND s.ch = t.ch AND s.y = t.y AND s.x = t.x")


def _dct_of(q, cells, bs):
    f = q.cte(f"SELECT k, i AS j, cos(pi() / {bs} * (i + 0.5) * k) AS f FROM unnest(range({bs})) AS a(k), unnest(range({bs})) AS b(i)", "basis")
    r = q.cte(f"SELECT image_id, ch, gy, gx, r, k AS w, sum(v * f) AS t FROM {cells} JOIN {f} ON j = i GROUP BY ALL")
    return q.cte(f"SELECT image_id, ch, gy, gx, k AS u, w, sum(t * f) AS c FROM {r} JOIN {f} ON j = r GROUP BY ALL")


add("block_analyze_ragged", lambda c: bl.coefficients(bl.block_analyze(c.activity(), 16)), lambda q: _dct_of(q, _mirrored(q, q.activity(), 16, False), 16), BK + " u w", "c")
add("block_analyze_overlap", lambda c: bl.coefficients(bl.block_analyze(c.activity(), 8, True)), lambda q: _dct_of(q, _mirrored(q, q.activity(), 8, True), 8), BK + " u w", "c")
add("block_round_trip", lambda c: bl.block_synthesize(bl.block_analyze(c.ship(), 16)), lambda q: q.ship(), PX, "v")
add("block_round_trip_overlap", lambda c: bl.block_synthesize(bl.block_analyze(c.ship(), 16, True), True), lambda q: q.ship(), PX, "v")
add("sine_window", lambda c: bl.windowed(c.plane(), 8),
    lambda q: q.cte(f"SELECT {q.PX}, v * sin(pi() * (y % 8 + 0.5) / 8) * sin(pi() * (x % 8 + 0.5) / 8) AS v FROM {q.plane()}"), PX, "v")


def _flat(c):
    """Supplier grids with a calm upper half, so that blocks of both sizes occur."""
    s = c.ship()
    calm = (C("y") < 64) & (C("image_id") % 2 == 0)
    return s.withColumn("v", F.when(calm, 100.0 + C("y") / 64.0).otherwise(C("v")))


def _flat_sql(q):
    return q.cte(f"SELECT {q.PX}, CASE WHEN y < 64 AND image_id % 2 = 0 THEN 100.0 + y / 64.0::DOUBLE ELSE v END AS v FROM {q.ship()}")


def _wide(c):
    """Four suppliers side by side: images wide enough for 32-blocks."""
    s = _flat(c)
    return s.select((F.floor(C("image_id") / 2)).alias("image_id"), "ch", "y", (C("x") + 31 * (C("image_id") % 2)).cast("int").alias("x"), "v")


def _wide_sql(q):
    return q.cte(f"SELECT image_id // 2 AS image_id, ch, y, x + 31 * (image_id % 2) AS x, v FROM {_flat_sql(q)}")


def _classes_sql(q, src, step):
    cell = q.cte(f"SELECT image_id, ch, y // 8 AS cy, x // 8 AS cx, greatest(avg(v * v) - avg(v) * avg(v), 0.0) AS var FROM {src} GROUP BY ALL")
    k = q.edge_class(q.block_mean(src, 16))
    big = q.cte(
        f"SELECT s.* FROM (SELECT image_id, ch, cy // 4 AS gy, cx // 4 AS gx FROM {cell} GROUP BY ALL HAVING count(*) = 16 AND max(var) < {step * step * 0.25}) s "
        f"JOIN (SELECT image_id, ch, y // 2 AS gy, x // 2 AS gx FROM {k} GROUP BY ALL HAVING bool_and(kind = 'none')) e USING (image_id, ch, gy, gx)")
    return q.cte(f"SELECT c.image_id, c.ch, c.cy, c.cx, CASE WHEN b.gy IS NULL THEN 16 ELSE 32 END AS bs FROM {cell} c LEFT JOIN {big} b ON b.image_id = c.image_id AND b.ch = c.ch AND b.gy = c.cy // 4 AND b.gx = c.cx // 4")


add("classify_blocks", lambda c: bl.classify_blocks(_wide(c), 20.0), lambda q: _classes_sql(q, _wide_sql(q), 20.0), "image_id ch cy cx bs")


def _iter_sql(q, src, step):
    c = _classes_sql(q, src, step)
    a = q.cte(f"SELECT DISTINCT image_id, ch, cy // (bs // 8) * (bs // 8) AS cy, cx // (bs // 8) * (bs // 8) AS cx, bs FROM {c}")
    return q.cte(f"SELECT image_id, ch, row_number() OVER (PARTITION BY image_id, ch ORDER BY cy, cx) - 1 AS block_id, cy * 8 AS y0, cx * 8 AS x0, bs FROM {a}")


add("iter_blocks", lambda c: bl.iter_blocks(bl.classify_blocks(_wide(c), 20.0)), lambda q: _iter_sql(q, _wide_sql(q), 20.0), "image_id ch block_id y0 x0 bs")
add("pixel_blocks", lambda c: bl.pixel_blocks(_wide(c), bl.classify_blocks(_wide(c), 20.0)),
    lambda q: q.cte(f"SELECT p.image_id, p.ch, p.y, p.x, p.v, bs, p.y // bs * bs AS y0, p.x // bs * bs AS x0 FROM {_wide_sql(q)} p JOIN {_classes_sql(q, _wide_sql(q), 20.0)} c ON c.image_id = p.image_id AND c.cy = p.y // 8 AND c.cx = p.x // 8"),
    PX + " bs y0 x0", "v")
add("variable_blocks_round_trip", lambda c: bl.variable_synthesize(bl.variable_analyze(_wide(c), bl.classify_blocks(_wide(c), 20.0))), lambda q: _wide_sql(q), PX, "v")


def _variable_dc_sql(q):
    s = _wide_sql(q)
    b, e = _iter_sql(q, s, 20.0), q.extent(s)
    m = lambda p, n: f"CASE WHEN {p} >= {n} THEN 2 * ({n} - 1) - ({p}) ELSE {p} END"
    t = q.cte(f"SELECT b.image_id, b.ch, y0, x0, bs, {m('y0 + r', 'h')} AS y, {m('x0 + i', 'w')} AS x FROM {b} b JOIN {e} e USING (image_id, ch), unnest(range(bs)) AS a(r), unnest(range(bs)) AS d(i)")
    return q.cte(f"SELECT t.image_id, t.ch, y0, x0, bs, avg(v) * 256 AS dc FROM {t} t JOIN {s} s ON s.image_id = t.image_id AND s.y = t.y AND s.x = t.x GROUP BY ALL")


add("variable_blocks_dc", lambda c: bl.variable_analyze(_wide(c), bl.classify_blocks(_wide(c), 20.0)).withColumn("dc", F.element_at("coef", 1)),
    _variable_dc_sql, "image_id ch y0 x0 bs", "dc")

# ---- lookups ------------------------------------------------------------


def _buckets(c):
    grid = sx.block_mean(c.ship(), 8)
    cells = c.ship().select(*PX.split(), "v")
    return lookup_field(cells, saliency_field(grid), 8)


add("field_lookup", _buckets,
    lambda q: q.cte(f"SELECT p.image_id, p.ch, p.y, p.x, t, grad, CASE WHEN t < 0.2 THEN 0 WHEN t < 0.5 THEN 1 WHEN t < 0.8 THEN 2 ELSE 3 END AS bucket FROM {q.ship()} p JOIN {q.field(q.block_mean(q.ship(), 8))} f ON f.image_id = p.image_id AND f.y = p.y // 8 AND f.x = p.x // 8"),
    PX + " bucket", "t grad")


# ---- quantisation study --------------------------------------------------


def _facts_sql(q, grid):
    f, v = q.strength(q.field(grid)), q.foveal(grid)
    return q.cte(f"SELECT g.image_id, g.ch, g.y AS gy, g.x AS gx, g.v AS lum, t, step_mod, strength, angle, foveal FROM {grid} g JOIN {f} f USING (image_id, ch, y, x) JOIN {v} v USING (image_id, ch, y, x)")


def _grid9_sql(q, src, bs):
    return q.cte(f"SELECT image_id, ch, y, x, round(v, 9) AS v FROM {q.block_mean(src, bs)}")


def _steps_sql(q, src, grid, qualities):
    a = q.cte(f"SELECT c.image_id, c.ch, c_norm, step_factor, q FROM {q.complexity(src)} c JOIN {q.scene(grid)} s USING (image_id, ch), (SELECT unnest({list(qualities)}) AS q)")
    return q.cte(f"SELECT image_id, ch, q, least(greatest((39.0 * exp(-3.5 * q / 100.0) + 0.9) * (1.0 - 0.4 * c_norm), 0.1), 48.0) * step_factor AS step FROM {a}")


def _quant_sql(q, coef, on):
    """Adds pos_step, dz, k, dec to coefficient rows; ``on`` is a SQL boolean."""
    zz = q.zigzag((8,))
    a = q.cte(f"SELECT *, CASE WHEN ({on}) AND strength > 0.15 THEN floor((angle - floor(angle / pi()) * pi()) / (pi() / 8) + 0.5)::BIGINT % 8 ELSE -1 END AS angle_idx FROM {coef} WHERE u + w > 0")
    b = q.cte(f"SELECT *, u / 7.0::DOUBLE AS nr, w / 7.0::DOUBLE AS nc, angle_idx * pi() / 8 AS th FROM {a}")
    d = q.cte(
        f"SELECT b.*, zz, CASE WHEN angle_idx < 0 THEN {SURF('nr', 'nc')} ELSE {SURF('(nr * cos(th) + nc * sin(th))', '(nc * cos(th) - nr * sin(th))')} END AS qm FROM {b} b JOIN {zz} z USING (u, w)")
    sm = "(power(least(greatest((q - 60.0) / 40.0, 0.0), 1.0), 2) * (3.0 - 2.0 * least(greatest((q - 60.0) / 40.0, 0.0), 1.0)))"
    ps = "(power(q / 100.0, 2) * (3.0 - 2.0 * q / 100.0))"
    piv = f"power(least(greatest(step_mod, 0.1), 10.0), 1.25 * (1.0 - {ps}) - 0.85 * {ps})"
    dzq = "CASE WHEN q <= 70 THEN 0.22::DOUBLE ELSE 0.22 * (1.0 - (q - 70.0) / 30.0) + 0.02 * (q - 70.0) / 30.0 END"
    dzp = f"CASE WHEN zz / 63.0 > 0.75 THEN greatest({dzq}, 0.2) WHEN zz / 63.0 > 0.5 THEN greatest({dzq}, 0.1) ELSE {dzq} END"
    csf = "(1.0 + 0.5 * (1.0 - least(greatest(lum / 255.0, 0.0), 1.0)) * (u * u + w * w) / 98.0)"
    e = q.cte(
        f"SELECT *, CASE WHEN {on} THEN greatest(step * 4.9 * foveal * {piv}, 0.1) * power(qm, 0.55 * (1.0 - {sm}) + 0.05 * {sm}) * {csf} ELSE greatest(step * 4.9, 0.1) END AS pos_step, "
        f"({dzp}) * CASE WHEN {on} THEN 1.0 + 0.3 * (1.0 - foveal) ELSE 1.0 END AS dz FROM {d}")
    k = q.cte(f"SELECT *, {Sql.deadzone('c', 'pos_step', 'dz')} AS k FROM {e}")
    return q.cte(f"SELECT *, k * pos_step AS dec FROM {k}")


def _study_rows(c, qualities):
    plane = c.plane()
    spectra = bl.block_analyze(plane, 8)
    grid = mean_grid(spectra)
    steps = steps_per_quality(plane, grid, qualities)
    co = bl.coefficients(spectra.select("image_id", "ch", "gy", "gx", "bs", "coef").join(block_facts(grid), BK.split()))
    return co.withColumn("c", F.round("c", 9)).join(steps, ["image_id", "ch"])


def _study_sql(q, qualities, extra=""):
    p = q.plane()
    g = _grid9_sql(q, p, 8)
    f, s = _facts_sql(q, g), _steps_sql(q, p, g, qualities)
    return q.cte(f"SELECT d.image_id, d.ch, d.gy, d.gx, u, w, round(c, 9) AS c, lum, t, step_mod, strength, angle, foveal, q, step{extra} FROM {q.dct(p, 8)} d JOIN {f} USING (image_id, ch, gy, gx) JOIN {s} s USING (image_id, ch)")


add("detail_steps", lambda c: steps_per_quality(c.plane(), sx.block_mean(c.plane(), 8), QUALITIES),
    lambda q: _steps_sql(q, q.plane(), q.block_mean(q.plane(), 8), QUALITIES), "image_id ch q", "step")
add("quantization_study", lambda c: bl.quantize(_study_rows(c, (50,))), lambda q: _quant_sql(q, _study_sql(q, (50,)), "TRUE"), BK + " u w zz k", "pos_step dz dec")
add("quantization_study_flat", lambda c: bl.quantize(_study_rows(c, (85,)), False), lambda q: _quant_sql(q, _study_sql(q, (85,)), "FALSE"), BK + " u w zz k", "pos_step dz dec")


def _rd_sql(q, qualities=QUALITIES):
    p = q.plane()
    g = _grid9_sql(q, p, 8)
    st = _steps_sql(q, p, g, qualities)
    co = q.cte(f"SELECT *, codec FROM {_study_sql(q, qualities)}, (SELECT unnest(['flat', 'weighted']) AS codec)")
    z = _quant_sql(q, co, "codec = 'weighted'")
    h = q.cte(f"SELECT image_id, codec, q, k, count(*) AS n, sum(power(c - dec, 2) * (CASE WHEN u > 0 THEN 2 ELSE 1 END) * (CASE WHEN w > 0 THEN 2 ELSE 1 END) / 64.0) AS d FROM {z} GROUP BY ALL")
    ac = q.cte(f"SELECT image_id, codec, q, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits, sum(d) AS se FROM {h} GROUP BY ALL")
    r = q.cte(f"SELECT image_id, min(v) AS lo, greatest(max(v) - min(v), 1e-6) AS span FROM {g} GROUP BY ALL")
    dzq = "CASE WHEN q <= 70 THEN 0.22::DOUBLE ELSE 0.22 * (1.0 - (q - 70.0) / 30.0) + 0.02 * (q - 70.0) / 30.0 END"
    n = q.cte(f"SELECT g.image_id, q, y, x, v, lo, span, greatest(step * 0.1, 0.2) AS unit, {Sql.deadzone('round((v - lo) * 255.0 / span, 9)', 'greatest(step * 0.1, 0.2)', dzq)} AS k FROM {g} g JOIN {r} USING (image_id) JOIN {st} s USING (image_id)")
    w = q.cte(f"SELECT *, lag(k) OVER (PARTITION BY image_id, q, y ORDER BY x) AS l, lag(k) OVER (PARTITION BY image_id, q, x ORDER BY y) AS t FROM {n}")
    w = q.cte(f"SELECT *, lag(l) OVER (PARTITION BY image_id, q, x ORDER BY y) AS d FROM {w}")
    mix = "((l * 0.6180339887498949::DOUBLE + t * 0.3819660112501051::DOUBLE + d * 0.2360679774997897::DOUBLE) / (0.6180339887498949::DOUBLE + 0.3819660112501051::DOUBLE + 0.2360679774997897::DOUBLE))"
    s = q.cte(f"SELECT *, (k - CASE WHEN d IS NOT NULL THEN {Sql.rha(mix)} ELSE coalesce(l, t, 0) END)::BIGINT AS res FROM {w}")
    hb = q.cte(f"SELECT image_id, q, res, count(*) AS n FROM {s} GROUP BY ALL")
    db = q.cte(f"SELECT image_id, q, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM {hb} GROUP BY ALL")
    de = q.cte(f"SELECT image_id, q, sum(power(v - (k * unit * span / 255.0 + lo), 2) * 64) AS se FROM {n} GROUP BY ALL")
    return q.cte(
        f"SELECT a.image_id, a.codec, a.q, (a.bits + b.bits) / 1280.0 AS bpp, 10.0 * log10(65025.0 / ((a.se + e.se) / 1280.0)) AS psnr FROM {ac} a JOIN {db} b USING (image_id, q) JOIN {de} e USING (image_id, q)")


add("rd_points", lambda c: rd_points(c.plane()), _rd_sql, "image_id q", "bpp psnr", "codec", digits=5)


def _rd_bd_sql(q):
    from gridloom.catalog.aggregates import bd_sql

    s = _rd_sql(q)
    return bd_sql(q, q.cte(f"SELECT a.image_id, a.q, a.bpp AS bpp_a, a.psnr AS psnr_a, b.bpp AS bpp_b, b.psnr AS psnr_b FROM {s} a JOIN {s} b USING (image_id, q) WHERE a.codec = 'weighted' AND b.codec = 'flat'"))


add("rd_bd_rate", lambda c: ql.bd_rate(rd_points(c.plane()), "weighted", "flat"), _rd_bd_sql, "image_id", "bd_rate", digits=4)


def _choice(c):
    z = bl.quantize(_study_rows(c, (50,)))
    return ql.coefficient_choice(z, [*BK.split(), "u", "w"], F.lit(0.7), F.lit(0.45), 400.0)


def _choice_sql(q):
    z = _quant_sql(q, _study_sql(q, (50,)), "TRUE")
    s = q.cte(f"SELECT image_id, ch, gy, gx, u, w, c, k, pos_step, abs(c) / pos_step AS nrm, CASE WHEN c >= 0 THEN 1 ELSE -1 END AS sg FROM {z}")
    o = q.cte(
        f"SELECT *, unnest(CASE WHEN nrm < 0.1 THEN [0] WHEN k = 0 AND nrm > 0.3 THEN [0, sg] WHEN k = 0 THEN [0] WHEN abs(k) BETWEEN 2 AND 4 THEN [k, k - sign(k), 0] ELSE [k, k - sign(k)] END)::BIGINT AS o FROM {s}")
    b = "CASE WHEN o = 0 THEN -log2(0.7) WHEN abs(o) = 1 THEN -log2(0.3) + 1 - log2(0.45) ELSE -log2(0.3) + 1 - log2(0.55) + 2 * length(bin(abs(o) - 1)) - 1 END"
    j = q.cte(f"SELECT *, power(c - o * pos_step, 2) + 400.0 * ({b}) AS j FROM {o}")
    return q.cte(f"SELECT image_id, ch, gy, gx, u, w, c, k, o AS chosen, j FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ch, gy, gx, u, w ORDER BY j, abs(o)) AS rn FROM {j}) WHERE rn = 1")


add("coefficient_choice", _choice, _choice_sql, BK + " u w k chosen", "j", digits=4)

# ---- channel prediction ---------------------------------------------------


def _chroma_coeffs(c):
    """Luma and one chroma of the colour images, part of the luma mixed in."""
    p = c.chroma()
    mix = F.when((F.floor(C("x") / 8) + F.floor(C("y") / 8)) % 2 == 0, 0.5).otherwise(0.0)
    luma = bl.coefficients(bl.block_analyze(p, 8)).where("u + w > 0").select("image_id", "gy", "gx", "u", "w", F.round("c", 9).alias("c"))
    side = bl.coefficients(bl.block_analyze(p.withColumn("v", C("c1") + mix * C("v")), 8)).where("u + w > 0")
    return luma, side.select("image_id", "gy", "gx", "u", "w", F.round("c", 9).alias("c"))


def _cfl_sql(q):
    p = q.chroma()
    s = q.cte(f"SELECT {q.PX}, c1 + CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 0.5 ELSE 0.0 END * v AS v FROM {p}")
    b = q.cte(f"SELECT l.image_id, l.gy, l.gx, l.u, l.w, round(l.c, 9) AS l, round(s.c, 9) AS c FROM {q.dct(p, 8)} l JOIN {q.dct(s, 8)} s USING (image_id, ch, gy, gx, u, w) WHERE l.u + l.w > 0")
    a = q.cte(f"SELECT image_id, gy, gx, sum(l * l) AS l2, sum(c * c) AS c2, sum(l * c) AS lc FROM {b} GROUP BY ALL")
    pal = "list_extract([-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0], least(greatest(ceil(lc / l2 * 4 - 0.5) + 4, 1), 8)::BIGINT)"
    g = q.cte(f"SELECT image_id, gy, gx, CASE WHEN l2 >= 1e-4 AND c2 >= 1e-4 AND lc * lc / (l2 * c2) >= 0.25 THEN {pal} ELSE 0 END::DOUBLE AS alpha FROM {a}".replace("ELSE 0 END::DOUBLE", "ELSE 0.0 END"))
    return q.cte(f"SELECT b.image_id, b.gy, b.gx, u, w, alpha, alpha <> 0 AS used, c - alpha * l AS residual, c AS restored FROM {b} b JOIN {g} USING (image_id, gy, gx)")


add("channel_prediction", lambda c: bl.channel_prediction(*_chroma_coeffs(c)), _cfl_sql, "image_id gy gx u w", "alpha residual restored", bools="used")


def _bucketed_prediction(c, buckets=8):
    """Channel prediction over tables bucketed by block: neither the joins nor the groupings exchange rows."""
    from gridloom.sources.buckets import write_bucketed

    key = ["image_id", "gy", "gx"]
    return bl.channel_prediction(*[write_bucketed(x, key, buckets, ["u", "w"]) for x in _chroma_coeffs(c)])


add("channel_prediction_bucketed", _bucketed_prediction, _cfl_sql, "image_id gy gx u w", "alpha residual restored", bools="used")


def _golden(c):
    g = sx.block_mean(c.ship(), 4)
    return bl.golden_residual(g.withColumn("q", F.floor(C("v") * 4).cast("int")))


def _golden_sql(q):
    g = q.cte(f"SELECT image_id, ch, y, x, floor(v * 4)::BIGINT AS q FROM {q.block_mean(q.ship(), 4)}")
    a = q.cte(f"SELECT *, lag(q) OVER (PARTITION BY image_id, y ORDER BY x) AS l, lag(q) OVER (PARTITION BY image_id, x ORDER BY y) AS t FROM {g}")
    a = q.cte(f"SELECT *, lag(l) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM {a}")
    mix = "((l * 0.6180339887498949::DOUBLE + t * 0.3819660112501051::DOUBLE + d * 0.2360679774997897::DOUBLE) / 1.2360679774997898::DOUBLE)"
    return q.cte(f"SELECT {q.PX}, q, q - CASE WHEN d IS NOT NULL THEN {Sql.rha(mix)} ELSE coalesce(l, t, 0) END AS residual FROM {a}")


add("golden_residual", _golden, _golden_sql, PX + " q residual")

add("top_energy", lambda c: top_energy(bl.coefficients(bl.block_analyze(c.plane(), 8)).where("u + w > 0").withColumns({"zz": C("u") * 8 + C("w"), "c": F.round("c", 6)}), BK.split(), 5),
    lambda q: q.cte(
        f"SELECT * FROM (SELECT *, row_number() OVER o AS rank, sum(c * c) OVER (o ROWS UNBOUNDED PRECEDING) / sum(c * c) OVER (PARTITION BY image_id, gy, gx) AS share FROM (SELECT image_id, ch, gy, gx, u, w, round(c, 6) AS c FROM {q.dct(q.plane(), 8)} WHERE u + w > 0) "
        f"WINDOW o AS (PARTITION BY image_id, gy, gx ORDER BY c * c DESC, u * 8 + w)) WHERE rank <= 5"),
    BK + " u w rank", "c share")

# ---- whole colour images ---------------------------------------------------
add("color_planes", lambda c: color_planes(c.pixels()),
    lambda q: q.cte(f"SELECT image_id, 0 AS ch, y, x, 255.0 * power(least(greatest(v / 255.0, 0.0), 1.0), 0.65::DOUBLE) AS v FROM {q.chroma()} UNION ALL SELECT image_id, 1, y, x, c1 FROM {q.chroma()} UNION ALL SELECT image_id, 2, y, x, c2 FROM {q.chroma()}"),
    PX, "v")
add("codec_reconstruct", lambda c: reconstruct(c.pixels(), 60, 8), None, "image_id y x r g b")
