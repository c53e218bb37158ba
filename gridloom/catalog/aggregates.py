"""Per-image statistics, scene classes and quality reports."""

from pyspark.sql import functions as F

from gridloom.catalog.base import Sql, add
from gridloom.functions.quant import detail_step, qmat_power, deadzone_quantize
from gridloom.operators import quality as ql
from gridloom.operators import stats as sx
from gridloom.operators.orderstat import normalize, order_statistic
from gridloom.sources.sinks import report_rows

C = F.col
PX = "image_id ch y x"
IM = "image_id ch"

add("grid_from_events", lambda c: c.activity(), lambda q: q.activity(), PX, "v")
add("grid_from_lineitem", lambda c: c.ship(), lambda q: q.ship(), PX, "v")
add("plane_from_arrays", lambda c: c.plane(), lambda q: q.plane(), PX, "v")
add("rgb_from_arrays", lambda c: c.pixels(), lambda q: q.pixels(), "image_id y x r g b")

add("block_mean", lambda c: sx.block_mean(c.ship(), 16), lambda q: q.block_mean(q.ship(), 16), PX, "v")
add("block_variance", lambda c: sx.block_variance(c.ship(), 8),
    lambda q: q.cte(f"SELECT image_id, ch, y // 8 AS cy, x // 8 AS cx, var_pop(v) AS var, avg(v) AS mean, count(*) AS n FROM {q.ship()} GROUP BY ALL"), IM + " cy cx n", "var mean")
for rule in ("unit", "byte", "byte_flat"):
    add(f"normalize_{rule}", lambda c, r=rule: normalize(c.ship(), ("image_id", "ch"), "v", r), lambda q, r=rule: q.normalize(q.ship(), "v", r), PX, "norm")


def _complex(c):
    df = sx.complexity(c.ship()).withColumn("q", F.explode(F.array(*map(F.lit, (20, 50, 90)))))
    return df.withColumn("step", detail_step(C("q"), C("c_norm")))


add("complexity", _complex,
    lambda q: q.cte(
        f"SELECT *, least(greatest((39.0 * exp(-3.5 * q / 100.0) + 0.9) * (1.0 - 0.4 * c_norm), 0.1), 48.0) AS step FROM {q.complexity(q.ship())}, (SELECT unnest([20, 50, 90]) AS q)"),
    IM + " q", "complexity c_norm step")


def _noise(c):
    p = c.pixels()
    return sx.noise_sigma(p.select("image_id", "y", "x", F.posexplode(F.array(*[C(k).cast("double") for k in "rgb"])).alias("ch", "v")))


def _noise_sql(q):
    p = q.cte(" UNION ALL ".join(f"SELECT image_id, {i} AS ch, y, x, {k} AS v FROM {q.pixels()}" for i, k in enumerate("rgb")))
    lap = q.cte(f"SELECT image_id, ch, n01 + n21 + n10 + n12 - 4.0 * v AS lap FROM {q.ring(p)} WHERE n00 IS NOT NULL AND n22 IS NOT NULL")
    d = q.cte(f"SELECT image_id, ch, abs(lap - med) AS dev FROM {lap} JOIN {q.stat(lap, 'lap', {'med': 0.5})} USING (image_id, ch)")
    return q.cte(f"SELECT image_id, avg(mad / (0.6745 * sqrt(20.0))) AS sigma FROM {q.stat(d, 'dev', {'mad': 0.5})} GROUP BY image_id")


add("noise_sigma", _noise, _noise_sql, "image_id", "sigma")
PS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
add("order_statistics", lambda c: order_statistic(c.ship(), ("image_id", "ch"), "v", PS), lambda q: q.stat(q.ship(), "v", PS), IM + " n", "p05 p50 p95")
add("order_statistics_fine", lambda c: order_statistic(c.table("lineitem"), ("l_returnflag",), "l_extendedprice", PS, buckets=16),
    lambda q: q.stat("lineitem", "l_extendedprice", PS, "l_returnflag"), "n", "p05 p50 p95", "l_returnflag")


def _hist_sql(q, src, bins):
    d = q.cte(f"SELECT image_id, ch, sqrt(dx * dx + dy * dy) AS mag, atan2(dy, dx) AS a FROM {q.fdiff(src)}")
    b = q.cte(f"SELECT *, least(floor((CASE WHEN a < 0 THEN a + pi() WHEN a >= pi() THEN a - pi() ELSE a END) / pi() * {bins}), {bins - 1}) AS bin FROM {d} WHERE mag >= 1.0")
    return q.cte(f"SELECT image_id, ch, bin, sum(mag) AS weight, sum(mag) / sum(sum(mag)) OVER (PARTITION BY image_id, ch) AS share FROM {b} GROUP BY image_id, ch, bin")


add("orientation_histogram", lambda c: sx.orientation_histogram(c.ship()), lambda q: _hist_sql(q, q.ship(), 4), IM + " bin", "weight share")
add("anisotropy", lambda c: sx.anisotropy(sx.orientation_histogram(c.plane(), 8), 8),
    lambda q: q.cte(f"SELECT image_id, ch, -sum(share * ln(share)) AS entropy, 1.0 + sum(share * ln(share)) / ln(8.0) AS anisotropy FROM {_hist_sql(q, q.plane(), 8)} GROUP BY ALL"),
    IM, "entropy anisotropy")

SCENE = dict(ints=IM, dbls="smooth_pct anisotropy velvet step_factor deblock", strs="scene", bools="lapped")
add("scene_class", lambda c: sx.scene_class(c.plane(), 4), lambda q: q.scene(q.block_mean(q.plane(), 4)), **SCENE)
add("scene_class_ship", lambda c: sx.scene_class(c.ship(), 4), lambda q: q.scene(q.block_mean(q.ship(), 4)), **SCENE)
add("scene_class_coarse", lambda c: sx.scene_class(c.plane(), 16), lambda q: q.scene(q.block_mean(q.plane(), 16)), **SCENE)


def _structure_sql(q):
    g = q.maxdiff(q.block_mean(q.ship(), 4))
    s = q.stat(g, "grad", {"med": 0.5})
    return q.cte(f"SELECT {q.PX}, 1.30 + least(greatest(grad / greatest(med, 1.0), 0.0) / 2.0, 1.0) * (0.80 - 1.30) AS factor FROM {g} JOIN {s} USING (image_id, ch)")


add("structure_factor", lambda c: sx.structure_factor(sx.block_mean(c.ship(), 4)), _structure_sql, PX, "factor", digits=9)
add("foveal_factor", lambda c: sx.foveal_factor(sx.block_mean(c.ship(), 4)), lambda q: q.foveal(q.block_mean(q.ship(), 4)), PX, "foveal")
add("edge_class", lambda c: sx.edge_class(sx.block_mean(c.ship(), 4)), lambda q: q.edge_class(q.block_mean(q.ship(), 4)), PX, "angle", "kind")


def _coherence(c):
    from gridloom.operators.blocks import block_analyze, coefficients

    return sx.coherence_factor(coefficients(block_analyze(c.plane(), 8)), ["image_id", "ch", "gy", "gx"])


def _coherence_sql(q):
    g = q.cte(
        f"SELECT image_id, ch, gy, gx, coalesce(sum(abs(c)) FILTER (u = 0), 0.0) AS eh, coalesce(sum(abs(c)) FILTER (w = 0), 0.0) AS ev, coalesce(sum(abs(c)) FILTER (u > 0 AND w > 0), 0.0) AS ed "
        f"FROM {q.dct(q.plane(), 8)} WHERE u + w > 0 GROUP BY ALL")
    return q.cte(f"SELECT *, CASE WHEN eh + ev + ed < 1 THEN 1.0 ELSE least(greatest(1.0 - 0.2 * greatest(greatest(eh, ev, ed) / (eh + ev + ed) - 0.33, 0.0) / 0.67, 0.8), 1.0) END AS factor FROM {g}")


add("coherence_factor", _coherence, _coherence_sql, IM + " gy gx", "eh ev ed factor")

# ---- primitives sets ----------------------------------------------------


def _prims(c):
    """Segments and arcs read off line items: three of four rows are segments."""
    li = c.table("lineitem")
    return li.select(
        C("l_suppkey").alias("image_id"), F.when(C("l_orderkey") % 4 == 0, "arc").otherwise("segment").alias("kind"), (C("l_orderkey") % 83).cast("int").alias("x1"), (C("l_partkey") % 79).cast("int").alias("y1"),
        ((C("l_orderkey") + C("l_quantity")) % 97).cast("int").alias("x2"), ((C("l_partkey") * 7 + 3) % 89).cast("int").alias("y2"), (C("l_quantity") + 1).cast("int").alias("radius"),
    )


def _sizes(c):
    return c.table("supplier").select(C("s_suppkey").alias("image_id"), (F.lit(300) + C("s_nationkey") * 60).alias("h"), F.lit(400).alias("w"))


def _shape_sql(q):
    p = q.cte(
        "SELECT l_suppkey AS image_id, l_orderkey % 4 <> 0 AS seg, (((l_orderkey + l_quantity)::BIGINT % 97) - (l_orderkey % 83))::DOUBLE AS dx, (((l_partkey * 7 + 3) % 89) - (l_partkey % 79))::DOUBLE AS dy, l_quantity + 1 AS radius FROM lineitem")
    a = q.cte(f"SELECT *, CASE WHEN seg THEN sqrt(dx * dx + dy * dy) ELSE radius * pi() * 0.5 END AS len, CASE WHEN dy = 0 THEN 0 WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + pi() ELSE atan2(dy, dx) END AS a FROM {p}")
    hs = ", ".join(f"coalesce(sum(len) FILTER (seg AND least(floor(a / pi() * 8), 7) = {b}), 0.0) AS h{b}" for b in range(8))
    g = q.cte(f"SELECT image_id, count(*) AS n, count(*) FILTER (seg) AS n_segments, count(*) FILTER (NOT seg) AS n_arcs, sum(len) AS tl, {hs} FROM {a} GROUP BY image_id")
    s = q.cte(f"SELECT s_suppkey AS image_id, 300 + s_nationkey * 60 AS h, 400 AS w, coalesce(n, 0) AS n, coalesce(n_segments, 0) AS n_segments, coalesce(n_arcs, 0) AS n_arcs, coalesce(tl, 0.0) AS tl, "
              + ", ".join(f"coalesce(h{b}, 0.0) AS h{b}" for b in range(8)) + f" FROM supplier LEFT JOIN {g} g ON g.image_id = s_suppkey")
    tot = "(" + " + ".join(f"h{b}" for b in range(8)) + ")"
    t = q.cte(f"SELECT *, {', '.join(f'CASE WHEN {tot} > 0 THEN h{b} / {tot} ELSE 0.0 END AS p{b}' for b in range(8))} FROM {s}")
    ent = " + ".join(f"CASE WHEN p{b} > 0 THEN -p{b} * ln(p{b}) ELSE 0.0 END" for b in range(8))
    top = " ".join(f"WHEN p{b} = greatest({', '.join(f'p{k}' for k in range(8))}) THEN {b}" for b in reversed(range(8)))
    u = q.cte(f"SELECT *, CASE WHEN n > 0 THEN 1.0 - ({ent}) / ln(8.0) ELSE 0.0 END AS anisotropy, CASE WHEN n > 0 THEN ((CASE {top} END) + 0.5) * pi() / 8 ELSE 0.0 END AS dominant, "
              f"CASE WHEN n_arcs > 0 THEN n_segments / n_arcs::DOUBLE WHEN n_segments > 0 THEN 100.0 ELSE 1.0 END AS ratio, CASE WHEN n > 0 THEN tl / n ELSE 0.0 END AS avg_length, n / (h * w / 1000.0::DOUBLE) AS density FROM {t}")
    v = q.cte(f"SELECT *, CASE WHEN n_segments > 10 THEN least(greatest((1.0 - (p0 + p4)) * anisotropy, 0.0), 1.0) ELSE 0.0 END AS perspective FROM {u}")
    w = q.cte(f"SELECT *, CASE WHEN density < 0.5 THEN 'Flat' WHEN perspective > 0.4 THEN 'Perspective' WHEN ratio > 3 AND anisotropy > 0.3 THEN 'Architectural' WHEN ratio < 0.5 THEN 'Organic' ELSE 'Mixed' END AS scene FROM {v}")
    pick = lambda vals: "CASE scene " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in zip(("Architectural", "Perspective", "Flat", "Organic", "Mixed"), vals)) + " END"
    return q.cte(f"SELECT *, {pick((1.5, 1.3, 0.5, 0.7, 1.0))} AS radius_factor, {pick((0.8, 0.9, 1.2, 1.0, 1.0))} AS threshold_factor, {pick((1.5, 1.3, 0.7, 0.8, 1.0))} AS deblock FROM {w}")


add("shape_profile", lambda c: sx.shape_profile(_prims(c), _sizes(c)), _shape_sql, "image_id n n_segments n_arcs",
    "ratio anisotropy dominant perspective avg_length density radius_factor threshold_factor deblock", "scene")

# ---- image pairs --------------------------------------------------------


def _compare_sql(q):
    p = q.pairs()
    e = q.cte(f"SELECT *, v_orig AS o, v_dec AS d FROM {p}")
    cols = []
    for f in "od":
        cols += [f"lag({f}) OVER r AS l{f}, lead({f}) OVER r AS r{f}, lag({f}) OVER c AS u{f}, lead({f}) OVER c AS b{f}"]
    n = q.cte(f"SELECT *, {', '.join(cols)} FROM {e} WINDOW r AS (PARTITION BY image_id, ch, y ORDER BY x), c AS (PARTITION BY image_id, ch, x ORDER BY y)")
    inn = "lo IS NOT NULL AND ro IS NOT NULL AND uo IS NOT NULL AND bo IS NOT NULL"
    s = []
    for f in "od":
        s.append(f"coalesce(sum(power(b{f} - {f}, 2) + power(r{f} - {f}, 2)), 0.0) AS e{f}, sum(abs(r{f} - l{f}) + abs(b{f} - u{f})) FILTER ({inn}) AS g1{f}, sum(abs(u{f} + b{f} + l{f} + r{f} - 4.0 * {f})) FILTER ({inn}) AS g2{f}")
    g = q.cte(f"SELECT image_id, ch, count(*) AS n, avg(power(o - d, 2)) AS mse, avg(abs(o - d)) AS mae, {', '.join(s)}, avg(abs(d - ld)) FILTER (x % 8 = 0 AND x > 0) AS seam, avg(abs(d - ld)) FILTER (x % 8 > 0) AS ins FROM {n} GROUP BY image_id, ch")
    return q.cte(f"SELECT image_id, ch, mse, mae, 10.0 * log10(65025.0 / mse) AS psnr, ed / eo AS edge_preservation, (g2d / g1d) / (g2o / g1o) AS smoothness_ratio, seam / ins AS blocking FROM {g}")


add("compare_quality", lambda c: ql.compare(c.pairs()), _compare_sql, IM, "mse mae psnr edge_preservation smoothness_ratio blocking")


def _diff_sql(q):
    d = q.cte(f"SELECT image_id, greatest(abs(r - r2), abs(g - g2), abs(b - b2)) AS d, power(r - r2, 2) + power(g - g2, 2) + power(b - b2, 2) AS se FROM {q.rgb_pairs()}")
    e = q.cte(f"SELECT image_id, d, se FROM {d} UNION ALL SELECT -1, d, se FROM {d}")
    return q.cte(
        f"SELECT image_id, t, count(*) FILTER (d > t) AS n_diff, 100.0 * count(*) FILTER (d > t) / count(*) AS pct, coalesce(avg(d) FILTER (d > t), 0.0) AS mean_diff, max(d) AS max_diff, "
        f"10.0 * log10(65025.0 / greatest(sum(se) / (3.0 * count(*)), 1e-10)) AS psnr FROM {e}, unnest(range(31)) AS r(t) GROUP BY image_id, t")


add("difference_report", lambda c: ql.difference_report(c.rgb_pairs()), _diff_sql, "image_id t n_diff max_diff", "pct mean_diff psnr")
add("pixel_pairs", lambda c: ql.pair(c.plane().select(*PX.split(), "v"), c.plane().select(*PX.split(), (8.0 * F.floor(C("v") / 8 + 0.5)).alias("v"))), lambda q: q.pairs(), PX, "v_orig v_dec")


def _bucketed_pairs(c, buckets=8):
    """Original and rounded planes from tables bucketed by image row: no exchange in the join."""
    from gridloom.sources.buckets import write_bucketed

    plane = c.plane().select(*PX.split(), "v")
    a = write_bucketed(plane, ["image_id", "ch", "y"], buckets, ["x"])
    b = write_bucketed(plane.withColumn("v", 8.0 * F.floor(C("v") / 8 + 0.5)), ["image_id", "ch", "y"], buckets, ["x"])
    return ql.pair(a, b)


add("pixel_pairs_bucketed", _bucketed_pairs, lambda q: q.pairs(), PX, "v_orig v_dec")


def _size(c):
    d = c.table("documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("h"))
    return d.select("source", ql.bits_per_pixel(C("bytes"), C("h"), F.lit(640)).alias("bpp"), ql.compression_ratio(C("bytes"), C("h"), F.lit(640)).alias("ratio"))


add("size_rates", _size,
    lambda q: q.cte("SELECT source, sum(n_chars) * 8.0 / (count(*) * 640) AS bpp, count(*) * 640.0 * 3 / sum(n_chars) AS ratio FROM documents GROUP BY source"), "", "bpp ratio", "source")

# ---- bit maps -----------------------------------------------------------


def _bits(c):
    g = sx.block_mean(c.plane(), 8).withColumn("idx", C("y") * 5 + C("x"))
    bit = F.when(C("v") > 127.5, F.expr("shiftleft(1, cast(idx % 8 as int))")).otherwise(0)
    return g.groupBy("image_id", F.floor(C("idx") / 8).alias("byte_idx")).agg(F.bit_or(bit).alias("byte"), F.bit_or(F.expr("shiftleft(1, cast(idx % 8 as int))")).alias("there"))


add("block_bitmap", _bits,
    lambda q: q.cte(f"SELECT image_id, (y * 5 + x) // 8 AS byte_idx, sum(CASE WHEN v > 127.5 THEN 1 << ((y * 5 + x) % 8) ELSE 0 END) AS byte FROM {q.block_mean(q.plane(), 8)} GROUP BY ALL"), "image_id byte_idx byte")


def _unbits(c):
    b = _bits(c).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return b.where("(shiftright(there, k) & 1) = 1").select("image_id", (C("byte_idx") * 8 + C("k")).alias("idx"), F.expr("shiftright(byte, k) & 1").alias("bit"))


add("block_bitmap_expand", _unbits,
    lambda q: q.cte(f"SELECT image_id, y * 5 + x AS idx, (v > 127.5)::INT AS bit FROM {q.block_mean(q.plane(), 8)}"), "image_id idx bit")


def _map(c):
    cells = sx.block_variance(c.ship(), 8)
    code = F.when(C("var") < 150, 2).when(C("var") < 300, 1).otherwise(0)
    idx = C("cy") * 4 + C("cx")
    return cells.groupBy("image_id", F.floor(idx / 4).alias("byte_idx")).agg(
        F.bit_or(code * F.element_at(F.array(*map(F.lit, (64, 16, 4, 1))), (idx % 4 + 1).cast("int"))).alias("byte"))


add("size_map_pack", _map,
    lambda q: q.cte(f"SELECT image_id, cy AS byte_idx, sum((CASE WHEN var < 150 THEN 2 WHEN var < 300 THEN 1 ELSE 0 END) << (6 - 2 * cx)) AS byte "
                    f"FROM (SELECT image_id, y // 8 AS cy, x // 8 AS cx, var_pop(v) AS var FROM {q.ship()} GROUP BY ALL) GROUP BY ALL"), "image_id byte_idx byte")

# ---- rate-distortion points ---------------------------------------------


def simple_points(c):
    """Cheap points for comparison reports: uniform and frequency-weighted steps."""
    from gridloom.operators.blocks import block_analyze, coefficients, qmat_table

    co = coefficients(block_analyze(c.plane(), 8)).withColumn("c", F.round("c", 9)).where("u + w > 0")
    t = F.broadcast(qmat_table(c.spark, (8,)).where("angle_idx = -1").select("u", "w", "qm"))
    co = co.join(t, ["u", "w"]).withColumn("q", F.explode(F.array(*map(F.lit, (20, 30, 40, 50, 60, 70, 80, 90)))))
    co = co.withColumn("codec", F.explode(F.array(F.lit("flat"), F.lit("weighted"))))
    base = (39.0 * F.exp(-3.5 * C("q") / 100.0) + 0.9) * 4.9
    co = co.withColumn("step", F.when(C("codec") == "flat", base * 3.0).otherwise(base * F.pow("qm", F.lit(0.55))))
    co = co.withColumn("k", deadzone_quantize(C("c"), C("step"), F.lit(0.22)))
    e = C("c") - C("k") * C("step")
    gain = F.when(C("u") > 0, 2.0).otherwise(1.0) * F.when(C("w") > 0, 2.0).otherwise(1.0) / 64.0
    h = co.groupBy("image_id", "codec", "q", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e * gain).alias("d"))
    n = F.sum("n")
    return h.groupBy("image_id", "codec", "q").agg(
        ((n * F.log2(n) - F.sum(C("n") * F.log2("n"))) / 1280.0).alias("bpp"), ql.psnr(F.sum("d") / 1280.0, 99.0).alias("psnr"))


def simple_points_sql(q):
    from gridloom.catalog.pointwise import SURF

    qm = SURF("u / 7.0::DOUBLE", "w / 7.0::DOUBLE")
    a = q.cte(f"SELECT image_id, u, w, round(c, 9) AS c, {qm} AS qm, q, codec FROM {q.dct(q.plane(), 8)}, (SELECT unnest([20, 30, 40, 50, 60, 70, 80, 90]) AS q), (SELECT unnest(['flat', 'weighted']) AS codec) WHERE u + w > 0")
    b = q.cte(f"SELECT *, (39.0 * exp(-3.5 * q / 100.0) + 0.9) * 4.9 * CASE WHEN codec = 'flat' THEN 3.0::DOUBLE ELSE power(qm, 0.55::DOUBLE) END AS step FROM {a}")
    k = q.cte(f"SELECT *, {Sql.deadzone('c', 'step', '0.22::DOUBLE')} AS k FROM {b}")
    h = q.cte(f"SELECT image_id, codec, q, k, count(*) AS n, sum(power(c - k * step, 2) * (CASE WHEN u > 0 THEN 2 ELSE 1 END) * (CASE WHEN w > 0 THEN 2 ELSE 1 END) / 64.0) AS d FROM {k} GROUP BY ALL")
    return q.cte(
        f"SELECT image_id, codec, q, (sum(n) * log2(sum(n)) - sum(n * log2(n))) / 1280.0 AS bpp, 10.0 * log10(65025.0 / (sum(d) / 1280.0)) AS psnr FROM {h} GROUP BY image_id, codec, q")


add("uniform_vs_weighted", simple_points, simple_points_sql, "image_id q", "bpp psnr", "codec")
add("report_rows", lambda c: report_rows(simple_points(c)), lambda q: simple_points_sql(q), "image_id q", "bpp psnr", "codec", digits=4)


def _pairs_sql(q):
    s = simple_points_sql(q)
    return q.cte(f"SELECT a.image_id, a.q, a.bpp AS bpp_a, a.psnr AS psnr_a, b.bpp AS bpp_b, b.psnr AS psnr_b FROM {s} a JOIN {s} b USING (image_id, q) WHERE a.codec = 'weighted' AND b.codec = 'flat'")


add("codec_pairs", lambda c: ql.pair_codecs(simple_points(c), "weighted", "flat"), _pairs_sql, "image_id q", "bpp_a psnr_a bpp_b psnr_b")


def _codecs_sql(q):
    m = lambda a, b: f"CASE WHEN {a} > {b} THEN 'win' WHEN {a} < {b} THEN 'loss' ELSE 'neutral' END"
    return q.cte(f"SELECT image_id, q, (24.0 / bpp_a - 24.0 / bpp_b) / (24.0 / bpp_b) * 100.0 AS size_pct, psnr_a - psnr_b AS psnr_delta, {m('bpp_b', 'bpp_a')} AS size_mark, {m('psnr_a', 'psnr_b')} AS psnr_mark FROM {_pairs_sql(q)}")


add("compare_codecs", lambda c: ql.compare_codecs(simple_points(c), "weighted", "flat"), _codecs_sql, "image_id q", "size_pct psnr_delta", "size_mark psnr_mark")


def bd_sql(q, pairs):
    """Cubics by orthogonal polynomials over the points of each curve; Simpson's rule is exact for them."""
    s = q.cte(f"SELECT image_id, greatest(min(psnr_a), min(psnr_b)) AS lo, least(max(psnr_a), max(psnr_b)) AS hi, min(least(bpp_a, bpp_b)) AS low FROM {pairs} GROUP BY image_id")
    c = q.cte(f"SELECT image_id, k, lo, hi, CASE WHEN k = 'a' THEN psnr_a ELSE psnr_b END AS x, ln(CASE WHEN k = 'a' THEN bpp_a ELSE bpp_b END) AS y FROM {pairs} JOIN {s} USING (image_id), (VALUES ('a'), ('b')) AS v(k) WHERE hi > lo AND low > 0")
    w = "OVER (PARTITION BY image_id, k)"
    a = q.cte(f"SELECT *, x - a0 AS q1 FROM (SELECT *, count(*) {w} AS n, avg(x) {w} AS a0, avg(y) {w} AS c0 FROM {c})")
    a = q.cte(f"SELECT *, (x - a1) * q1 - s1 / n AS q2 FROM (SELECT *, sum(q1 * q1) {w} AS s1, sum(x * q1 * q1) {w} / sum(q1 * q1) {w} AS a1, sum(y * q1) {w} / sum(q1 * q1) {w} AS c1 FROM {a})")
    a = q.cte(f"SELECT *, (x - a2) * q2 - s2 / s1 * q1 AS q3 FROM (SELECT *, sum(q2 * q2) {w} AS s2, sum(x * q2 * q2) {w} / sum(q2 * q2) {w} AS a2, sum(y * q2) {w} / sum(q2 * q2) {w} AS c2 FROM {a})")
    f = q.cte(f"SELECT image_id, k, count(DISTINCT x) AS d, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, any_value(s1) AS s1, any_value(s2) AS s2, "
              f"any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, sum(y * q3) / sum(q3 * q3) AS c3 FROM {a} GROUP BY ALL")
    e = q.cte(f"SELECT *, t - a0 AS p1, (t - a1) * (t - a0) - s1 / n AS p2 FROM {f}, (VALUES (0.0::DOUBLE, 1), (0.5::DOUBLE, 4), (1.0::DOUBLE, 1)) AS g(r, wt), LATERAL (SELECT lo + (hi - lo) * r AS t)")
    m = q.cte(f"SELECT image_id, k, min(d) AS d, sum(wt * (c0 + c1 * p1 + c2 * p2 + c3 * ((t - a2) * p2 - s2 / s1 * p1))) / 6.0 AS mean FROM {e} GROUP BY ALL")
    r = q.cte(f"SELECT image_id, CASE WHEN min(d) >= 4 THEN (exp(max(mean) FILTER (k = 'a') - max(mean) FILTER (k = 'b')) - 1.0) * 100.0 END AS bd_rate FROM {m} GROUP BY image_id")
    return q.cte(f"SELECT image_id, bd_rate FROM {s} LEFT JOIN {r} USING (image_id)")


add("bd_rate", lambda c: ql.bd_rate(simple_points(c), "weighted", "flat"), lambda q: bd_sql(q, _pairs_sql(q)), "image_id", "bd_rate")
add("bd_summary", lambda c: ql.bd_summary(ql.bd_rate(simple_points(c), "weighted", "flat")),
    lambda q: q.cte(f"SELECT avg(bd_rate) AS avg_bd_rate, count(*) FILTER (bd_rate < 0) AS wins, count(bd_rate) AS n, count(*) - count(bd_rate) AS n_undefined FROM {bd_sql(q, _pairs_sql(q))}"), "wins n n_undefined", "avg_bd_rate")
add("operating_point", lambda c: ql.operating_point(simple_points(c), 50.0),
    lambda q: q.cte(
        f"SELECT image_id, codec, q, bpp, psnr, j FROM (SELECT *, row_number() OVER (PARTITION BY image_id, codec ORDER BY j, q) AS rn FROM (SELECT *, 65025.0 / power(10.0, psnr / 10.0) + 50.0 * bpp AS j FROM {simple_points_sql(q)})) WHERE rn = 1"),
    "image_id q", "bpp psnr j", "codec")
add("within_budget", lambda c: ql.within_budget(simple_points(c), 1.5),
    lambda q: q.cte(f"SELECT image_id, codec, q, bpp, psnr FROM (SELECT *, row_number() OVER (PARTITION BY image_id, codec ORDER BY psnr DESC, q) AS rn FROM {simple_points_sql(q)} WHERE bpp <= 1.5) WHERE rn = 1"),
    "image_id q", "bpp psnr", "codec")
