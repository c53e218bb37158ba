"""Point-wise projections, predicates and scan orders."""

import math

from pyspark.sql import functions as F

from gridloom.catalog.base import Sql, add
from gridloom.constants import AC_STEP_FACTOR, PHI_INV
from gridloom.functions import color, index, numeric, quant, symbols
from gridloom.operators import orders
from gridloom.operators.blocks import qmat_table
from gridloom.operators.stats import complexity

C = F.col
PHI, I1, I2 = "1.618033988749895::DOUBLE", "0.6180339887498949::DOUBLE", "0.3819660112501051::DOUBLE"


def cols(df, keep, **named):
    """Select key columns plus named expressions (tuples are spread over 'a b c' names)."""
    out = [C(k) for k in keep.split()]
    for names, e in named.items():
        parts = e if isinstance(e, tuple) else (e,)
        out += [p.alias(n) for n, p in zip(names.split("__"), parts)]
    return df.select(*out)


RGB = "image_id y x"
PX = "image_id ch y x"
SRGB = "image_id, y, x"

add("gct_forward", lambda c: cols(c.pixels(), RGB, l__c1__c2=color.gct_forward(C("r"), C("g"), C("b"))),
    lambda q: q.cte(f"SELECT {SRGB}, v AS l, c1, c2 FROM {q.chroma()}"), RGB, "l c1 c2")

add("gct_inverse", lambda c: cols(c.chroma(), RGB, r__g__b=color.gct_inverse(C("v"), C("c1"), C("c2"))),
    lambda q: q.cte(f"SELECT {SRGB}, v + c2 AS r, v - {I2} * c1 - {I1} * c2 AS g, v + c1 AS b FROM {q.chroma()}"), RGB, "r g b")

YCC = ("least(greatest(0.299 * r + 0.587 * g + 0.114 * b, 0.0), 255.0) AS yy, "
       "least(greatest(-0.169 * r - 0.331 * g + 0.500 * b + 128.0, 0.0), 255.0) AS cb, "
       "least(greatest(0.500 * r - 0.419 * g - 0.081 * b + 128.0, 0.0), 255.0) AS cr")
add("rgb_to_ycbcr", lambda c: cols(c.pixels(), RGB, yy__cb__cr=color.rgb_to_ycbcr(C("r"), C("g"), C("b"))),
    lambda q: q.cte(f"SELECT {SRGB}, {YCC} FROM {q.pixels()}"), RGB, "yy cb cr")


def _ycc_back(c):
    # Rounded first, so that truncation sees the same value in every engine.
    y = [F.round(v, 9) for v in color.rgb_to_ycbcr(C("r"), C("g"), C("b"))]
    return cols(c.pixels(), RGB, r__g__b=color.ycbcr_to_rgb(*y))


def _ycc_back_sql(q):
    a = q.cte(f"SELECT {SRGB}, {YCC} FROM {q.pixels()}")
    b = q.cte(f"SELECT {SRGB}, round(yy, 9) AS yy, round(cb, 9) - 128.0 AS u, round(cr, 9) - 128.0 AS v FROM {a}")
    t = lambda e: f"trunc(least(greatest({e}, 0.0), 255.0))"
    return q.cte(f"SELECT {SRGB}, {t('yy + 1.402 * v')} AS r, {t('yy - 0.344136 * u - 0.714136 * v')} AS g, {t('yy + 1.772 * u')} AS b FROM {b}")


add("ycbcr_to_rgb", _ycc_back, _ycc_back_sql, RGB + " r g b")

add("tone_curve", lambda c: cols(c.plane(), PX, tone=color.tone(C("v")), back=color.tone_inverse(color.tone(C("v")))),
    lambda q: q.cte(f"SELECT {q.PX}, tone, 255.0 * power(least(greatest(tone / 255.0, 0.0), 1.0), 1.0 / 0.65) AS back FROM (SELECT *, 255.0 * power(v / 255.0, 0.65::DOUBLE) AS tone FROM {q.plane()})"),
    PX, "tone back")

add("to_u8", lambda c: cols(c.plane(), PX, u8=numeric.to_u8(C("v") * 1.25 - 20.25)),
    lambda q: q.cte(f"SELECT {q.PX}, round(least(greatest(v * 1.25::DOUBLE - 20.25, 0.0), 255.0)) AS u8 FROM {q.plane()}"), PX + " u8")

add("saturation_factor",
    lambda c: cols(c.chroma(), RGB, raw=color.saturation_raw(C("c1"), C("c2")), factor=color.phi_chroma_factor(F.least(color.saturation_raw(C("c1"), C("c2")) / 255.0, F.lit(1.0)))),
    lambda q: q.cte(f"SELECT {SRGB}, raw, {I2} + (1.0 - {I2}) * (1.0 - s) * (1.0 - s) AS factor FROM (SELECT *, sqrt(c1 * c1 + c2 * c2) AS raw, least(sqrt(c1 * c1 + c2 * c2) / 255.0, 1.0) AS s FROM {q.chroma()})"),
    RGB, "raw factor")

add("luma_zone_factor", lambda c: cols(c.plane(), PX, factor=quant.luma_zone_factor(C("v"))),
    lambda q: q.cte(f"SELECT {q.PX}, CASE WHEN v < 64 THEN 0.7 WHEN v < 128 THEN 0.9 WHEN v < 192 THEN 1.0 ELSE 1.2 END AS factor FROM {q.plane()}"), PX, "factor")

add("csf_factor", lambda c: cols(c.plane(), PX, factor=quant.csf_factor(C("y") % 8, C("x") % 8, F.lit(8), C("v"))),
    lambda q: q.cte(f"SELECT {q.PX}, 1.0 + 0.5 * (1.0 - v / 255.0) * power(sqrt(power(y % 8, 2) + power(x % 8, 2)) / (7 * sqrt(2.0)), 2) AS factor FROM {q.plane()}"), PX, "factor")

QA, QAL, QB, QG = "(5.0 * pi() + 2.0)", "(11.0 / 13.0)::DOUBLE", f"(5.0 * {PHI} / 9.0)", "(176.0 * pi() / 35.0)"
SURF = lambda r, c: f"greatest({QA} * power(sqrt(({r}) * ({r}) + {QAL} * ({c}) * ({c})), {QB}) + {QG} * ({r}) * ({c}), 0.1)"


def _qmat_spark(c):
    t = F.broadcast(qmat_table(c.spark, (8,)).where("angle_idx = -1"))
    p = c.plane().withColumns({"u": C("y") % 8, "w": C("x") % 8})
    return p.join(t, ["u", "w"]).groupBy("image_id", "u", "w", "qm").agg(F.sum(C("v") / C("qm")).alias("units"))


def _qmat_sql(q):
    return q.cte(
        f"SELECT image_id, y % 8 AS u, x % 8 AS w, {SURF('(y % 8) / 7.0::DOUBLE', '(x % 8) / 7.0::DOUBLE')} AS qm, sum(v / {SURF('(y % 8) / 7.0::DOUBLE', '(x % 8) / 7.0::DOUBLE')}) AS units "
        f"FROM {q.plane()} WHERE y % 8 + x % 8 > 0 GROUP BY ALL")


add("qmat", _qmat_spark, _qmat_sql, "image_id u w", "qm units")


def _qrot(c):
    p = c.plane().withColumns({"u": C("y") % 8, "w": C("x") % 8, "bs": F.lit(8), "angle_idx": quant.angle_index(C("v") / 40.0 - 3.0)})
    t = F.broadcast(qmat_table(c.spark, (8,)).where("angle_idx >= 0"))
    return p.join(t, ["bs", "angle_idx", "u", "w"]).select("image_id", "ch", "y", "x", "angle_idx", F.pow("qm", F.lit(0.55)).alias("weight"))


def _qrot_sql(q):
    a = q.cte(f"SELECT *, v / 40.0 - 3.0 AS a FROM {q.plane()} WHERE y % 8 + x % 8 > 0")
    b = q.cte(f"SELECT *, floor((a - floor(a / pi()) * pi()) / (pi() / 8) + 0.5)::BIGINT % 8 AS angle_idx, (y % 8) / 7.0::DOUBLE AS r, (x % 8) / 7.0::DOUBLE AS c FROM {a}")
    d = q.cte(f"SELECT *, r * cos(angle_idx * pi() / 8) + c * sin(angle_idx * pi() / 8) AS rr, -r * sin(angle_idx * pi() / 8) + c * cos(angle_idx * pi() / 8) AS cc FROM {b}")
    return q.cte(f"SELECT {q.PX}, angle_idx, power({SURF('rr', 'cc')}, 0.55::DOUBLE) AS weight FROM {d}")


add("qmat_rotated", _qrot, _qrot_sql, PX + " angle_idx", "weight")

add("saliency_bucket", lambda c: cols(c.plane(), PX, bucket=quant.saliency_bucket(C("v") / 255.0)),
    lambda q: q.cte(f"SELECT {q.PX}, CASE WHEN v / 255.0 < 0.2 THEN 0 WHEN v / 255.0 < 0.5 THEN 1 WHEN v / 255.0 < 0.8 THEN 2 ELSE 3 END AS bucket FROM {q.plane()}"), PX + " bucket")

add("psychovisual_pivot", lambda c: cols(c.plane(), PX, factor=quant.psychovisual_pivot(C("v") / 128.0, C("x") * 2.5)),
    lambda q: q.cte(f"SELECT {q.PX}, power(least(greatest(v / 128.0, 0.1), 10.0), 1.25 * (1.0 - s) - 0.85 * s) AS factor FROM (SELECT *, power(x * 2.5::DOUBLE / 100.0, 2) * (3.0 - 2.0 * (x * 2.5::DOUBLE / 100.0)) AS s FROM {q.plane()})"),
    PX, "factor")


def _ladder(c):
    df = complexity(c.plane()).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(100))))
    q = C("q").cast("double")
    step = quant.detail_step(q, C("c_norm"))
    return df.select(
        "image_id", "q", step.alias("step"), quant.dc_step(step).alias("dc_step"), quant.dead_zone(q).alias("dz"),
        quant.dead_zone_at(C("q"), F.lit(100), quant.dead_zone(q)).alias("dz_at"), quant.qmat_power(q).alias("power"),
        quant.spin_weight(q).alias("spin"), quant.rd_lambda(q, step).alias("lambda"), (step * AC_STEP_FACTOR).alias("ac_step"),
    )


def _ladder_sql(q):
    sm = lambda t: f"(power(least(greatest({t}, 0.0), 1.0), 2) * (3.0 - 2.0 * least(greatest({t}, 0.0), 1.0)))"
    a = q.cte(f"SELECT image_id, c_norm, q::DOUBLE AS q FROM {q.complexity(q.plane())}, unnest(range(1, 101)) AS r(q)")
    b = q.cte(
        f"SELECT image_id, q, least(greatest((39.0 * exp(-3.5 * greatest(q / 100.0, 0.01)) + 0.9) * (1.0 - 0.4 * c_norm), 0.1), 48.0) AS step, "
        f"CASE WHEN q <= 70 THEN 0.22 ELSE 0.22 * (1.0 - (q - 70.0) / 30.0) + 0.02 * (q - 70.0) / 30.0 END AS dz FROM {a}")
    return q.cte(
        f"SELECT image_id, q, step, greatest(step * 0.1, 0.2) AS dc_step, dz, CASE WHEN q / 100 > 0.75 THEN greatest(dz, 0.2) WHEN q / 100 > 0.5 THEN greatest(dz, 0.1) ELSE dz END AS dz_at, "
        f"CASE WHEN q <= 60 THEN 0.55 ELSE 0.55 * (1.0 - {sm('(q - 60.0) / 40.0')}) + 0.05 * {sm('(q - 60.0) / 40.0')} END AS power, 0.05 + 0.33 * (1.0 - greatest(q / 100.0, 0.01)) AS spin, "
        f"greatest(step * step / 8.33 * (1.5 * (1.0 - {sm('(q - 50.0) / 40.0')}) + 0.3 * {sm('(q - 50.0) / 40.0')}) * 5.0, 0.01) AS lambda, step * 4.9 AS ac_step FROM {b}")


add("quality_ladder", _ladder, _ladder_sql, "image_id q", "step dc_step dz dz_at power spin lambda ac_step")


def _dzq(c):
    k = quant.deadzone_quantize(C("v") - 127.5, F.lit(7.3), F.lit(0.22))
    return cols(c.plane(), PX, k=k, dec=k * 7.3)


add("deadzone_quantize", _dzq, lambda q: q.cte(f"SELECT *, k * 7.3::DOUBLE AS dec FROM (SELECT {q.PX}, {Sql.deadzone('(v - 127.5)', '7.3::DOUBLE', '0.22::DOUBLE')} AS k FROM {q.plane()})"), PX + " k", "dec")

LEVELS = "(VALUES (1), (2), (3), (5), (8), (13), (21), (34)) AS l(lev)"
add("snap_to_levels", lambda c: cols(c.plane(), PX, level=numeric.snap_to_levels((C("v") - 127.0) / 3.0)),
    lambda q: q.cte(f"SELECT {q.PX}, CASE WHEN abs(f) < 0.5 THEN 0 ELSE sign(f) * lev END AS level FROM (SELECT {q.PX}, f, arg_min(lev, abs(abs(f) - lev) + lev * 1e-9) AS lev FROM (SELECT *, (v - 127.0) / 3.0 AS f FROM {q.plane()}), {LEVELS} GROUP BY ALL)"),
    PX + " level")

add("palette_quantize", lambda c: cols(c.plane(), PX, alpha=numeric.quantize_to_palette((C("v") - 127.0) / 100.0)),
    lambda q: q.cte(f"SELECT {q.PX}, arg_min(a, abs((v - 127.0) / 100.0 - a) + a * 1e-9) AS alpha FROM {q.plane()}, (SELECT unnest([-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]) AS a) GROUP BY {q.PX}"),
    PX, "alpha")

add("angle_diff", lambda c: cols(c.plane(), PX, d=numeric.angle_diff(C("v") / 20.0, C("x") / 5.0)),
    lambda q: q.cte(f"SELECT {q.PX}, d - floor(d / (2 * pi())) * 2 * pi() - pi() AS d FROM (SELECT *, v / 20.0 - x / 5.0::DOUBLE + pi() AS d FROM {q.plane()})"), PX, "d")

add("code_bits", lambda c: cols(c.plane(), PX, eg=quant.exp_golomb_bits(C("v").cast("long")), ideal=quant.bits((C("v") + 1) / 257.0)),
    lambda q: q.cte(f"SELECT {q.PX}, 2 * length(bin((v + 1)::BIGINT)) - 1 AS eg, -log2((v + 1) / 257.0) AS ideal FROM {q.plane()}"), PX + " eg", "ideal")

add("symbol_classes",
    lambda c: cols(c.plane(), PX, run=symbols.run_class(C("v")), run6=symbols.run_class_long(C("v")), energy=symbols.energy_bucket(C("v")), mag=symbols.magnitude_bucket(F.abs(C("v") - 128.0))),
    lambda q: q.cte(
        f"SELECT {q.PX}, CASE WHEN v < 1 THEN 0 WHEN v < 2 THEN 1 WHEN v < 4 THEN 2 ELSE 3 END AS run, CASE WHEN v = 0 THEN 0 WHEN v = 1 THEN 1 WHEN v <= 3 THEN 2 WHEN v <= 15 THEN 3 WHEN v <= 63 THEN 4 ELSE 5 END AS run6, "
        f"CASE WHEN v < 16 THEN 0 WHEN v < 64 THEN 1 WHEN v < 160 THEN 2 ELSE 3 END AS energy, CASE WHEN abs(v - 128) = 0 THEN 0 WHEN abs(v - 128) = 1 THEN 1 WHEN abs(v - 128) <= 3 THEN 2 ELSE 3 END AS mag FROM {q.plane()}"),
    PX + " run run6 energy mag")

add("rate_bits", lambda c: cols(c.plane(), PX, bits=quant.rate_bits(F.floor((C("v") - 128) / 16).cast("int"), F.lit(0.7), F.lit(0.4))),
    lambda q: q.cte(
        f"SELECT {q.PX}, CASE WHEN s = 0 THEN -log2(0.7) WHEN abs(s) = 1 THEN -log2(0.3) + 1 - log2(0.4) ELSE -log2(0.3) + 1 - log2(0.6) + 2 * length(bin(abs(s) - 1)) - 1 END AS bits "
        f"FROM (SELECT *, floor((v - 128) / 16)::BIGINT AS s FROM {q.plane()})"), PX, "bits")

add("index_maps",
    lambda c: cols(c.plane(), PX, mirror=index.mirror_index(C("x") * 3 - 60, C("y") + 1), clamped=index.clamp_index(C("x") - 20, C("y") + 1), reflect=index.reflect_index(C("x") - 20, C("y") + 1)),
    lambda q: q.cte(
        f"SELECT {q.PX}, CASE WHEN y = 0 THEN 0 WHEN m > y THEN 2 * y - m ELSE m END AS mirror, least(greatest(x - 20, 0), y) AS clamped, {Sql.border('(x - 20)', '(y + 1)', 'reflect')} AS reflect "
        f"FROM (SELECT *, ((x * 3 - 60) % greatest(2 * y, 1) + greatest(2 * y, 1)) % greatest(2 * y, 1) AS m FROM {q.plane()})"), PX + " mirror clamped reflect")

add("pixel_filters",
    lambda c: c.chroma().groupBy("image_id").agg(
        F.count_if(color.saturation_raw(C("c1"), C("c2")) / 100.0 > PHI_INV).alias("saturated"), F.count_if(F.abs("c1") > 6.0).alias("edgy"),
        F.count_if(F.abs("c1") + F.abs("c2") > 0.5).alias("energetic"), F.count_if(F.abs(C("v") - 128.0) > 30).alias("changed")),
    lambda q: q.cte(
        f"SELECT image_id, count(*) FILTER (sqrt(c1 * c1 + c2 * c2) / 100.0 > {I1}) AS saturated, count(*) FILTER (abs(c1) > 6) AS edgy, "
        f"count(*) FILTER (abs(c1) + abs(c2) > 0.5) AS energetic, count(*) FILTER (abs(v - 128) > 30) AS changed FROM {q.chroma()} GROUP BY image_id"),
    "image_id saturated edgy energetic changed")

# ---- scan orders -------------------------------------------------------


def _zz(c):
    t = F.broadcast(orders.zigzag_table(c.spark, (8, 16)))
    p = c.plane().withColumn("bs", F.explode(F.array(F.lit(8), F.lit(16))))
    p = p.withColumns({"u": C("y") % C("bs"), "w": C("x") % C("bs")})
    return p.join(t, ["bs", "u", "w"]).groupBy("image_id", "bs", "zz").agg(F.avg("v").alias("mean"))


add("zigzag_order", _zz,
    lambda q: q.cte(f"SELECT image_id, bs, zz, avg(v) AS mean FROM {q.plane()} p JOIN {q.zigzag((8, 16))} z ON z.u = p.y % z.bs AND z.w = p.x % z.bs GROUP BY ALL"),
    "image_id bs zz", "mean")

SPREAD = lambda v: " + ".join(f"((({v}) >> {i}) & 1) * {4 ** i}" for i in range(12))
add("morton_order", lambda c: orders.morton_rank(c.ship(), chunk=1 << 8),
    lambda q: q.cte(f"SELECT {q.PX}, v, row_number() OVER (PARTITION BY image_id ORDER BY {SPREAD('x')} + 2 * ({SPREAD('y')})) - 1 AS rank FROM {q.ship()}"), PX + " rank", "v")


def _cover(q, src):
    e = q.extent(src)
    k = q.cte(f"SELECT image_id, ch, h, w, k, sqrt(k / (h * w)::DOUBLE) * sqrt(power(h / 2.0, 2) + power(w / 2.0, 2)) AS r, k * 2.3999632297286535::DOUBLE AS th FROM {e}, unnest(range(h * w)) AS r(k)")
    m = q.cte(f"SELECT *, h / 2.0::DOUBLE + r * sin(th) AS py, w / 2.0::DOUBLE + r * cos(th) AS px FROM {k}")
    hit = q.cte(f"SELECT image_id, ch, least(greatest({Sql.rha('py')}, 0), h - 1)::BIGINT AS y, least(greatest({Sql.rha('px')}, 0), w - 1)::BIGINT AS x, min(k) AS k FROM {m} GROUP BY ALL")
    o = q.cte(f"SELECT s.image_id, s.ch, s.y, s.x, s.v, coalesce(k, h * w + s.y * w + s.x) AS k FROM {src} s JOIN {e} USING (image_id, ch) LEFT JOIN {hit} t ON t.image_id = s.image_id AND t.ch = s.ch AND t.y = s.y AND t.x = s.x")
    return q.cte(f"SELECT {q.PX}, v, row_number() OVER (PARTITION BY image_id, ch ORDER BY k) - 1 AS rank FROM {o}")


add("covering_order", lambda c: orders.covering_order(c.ship(), chunk=1 << 8), lambda q: _cover(q, q.ship()), PX + " rank")
add("inverse_order", lambda c: orders.inverse_order(orders.covering_order(c.activity())),
    lambda q: q.cte(f"SELECT image_id, ch, rank, y * 30 + x AS raster FROM {_cover(q, q.activity())}"), "image_id ch rank raster")
add("scan_monotonicity", lambda c: orders.monotonicity(orders.covering_order(c.ship())),
    lambda q: q.cte(
        f"SELECT image_id, ch, avg(CASE WHEN v < p - 0.5 THEN 100.0 ELSE 0.0 END) AS violations FROM (SELECT *, lag(v) OVER (PARTITION BY image_id, ch ORDER BY rank) AS p FROM {_cover(q, q.ship())}) WHERE p IS NOT NULL GROUP BY ALL"),
    "image_id ch", "violations")
