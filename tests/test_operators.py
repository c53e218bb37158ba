"""Closed forms, invariants and brute-force comparisons on small inputs."""
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import color, quant
from gridloom.operators import blocks as bl
from gridloom.operators import filters as fl
from gridloom.operators import patches as pt
from gridloom.operators import quality as ql
from gridloom.operators import sequences as sq
from gridloom.operators import stencil as st
from gridloom.operators import structure as gs
from gridloom.operators.orders import covering_order
from gridloom.operators.orderstat import normalize, order_statistic
from gridloom.operators.saliency import saliency_field
from gridloom.operators.stats import scene_class

RNG = np.random.default_rng(5)
NOISE = RNG.integers(0, 256, (19, 27)).astype(float)


def test_color_round_trip(spark):
    df = spark.createDataFrame([(200, 100, 50), (0, 0, 0), (255, 255, 255), (128, 128, 128)], "r int, g int, b int")
    l, c1, c2 = color.gct_forward(F.col("r"), F.col("g"), F.col("b"))
    back = color.gct_inverse(l, c1, c2)
    for row in df.select("r", "g", "b", *[e.alias(n) for e, n in zip(back, "xyz")], c1.alias("c1")).collect():
        assert max(abs(row.x - row.r), abs(row.y - row.g), abs(row.z - row.b)) < 1e-10
        if row.r == row.g == row.b:
            assert abs(row.c1) < 1e-10


def test_quality_curves(spark):
    q = F.col("id").cast("double")
    df = spark.range(1, 101).select(quant.dead_zone(q).alias("dz"), quant.qmat_power(q).alias("p"), quant.spin_weight(q).alias("s")).toPandas()
    assert abs(df.dz[69] - 0.22) < 1e-12 and abs(df.p[59] - 0.55) < 1e-12
    assert all((df[c].diff().dropna() <= 1e-12).all() for c in df)


@pytest.mark.parametrize("op,column", [
    (lambda p, t: st.sobel(p, tile=t), "mag"), (lambda p, t: st.gaussian_blur(p, 1.0, border="reflect", radius=4, tile=t), "blur"),
    (lambda p, t: fl.sigma_filter(p, 24.0, tile=t), "out"), (lambda p, t: saliency_field(p, tile=t), "t"),
])
def test_tile_size_does_not_matter(plane_of, array_of, op, column):
    p = plane_of(NOISE)
    np.testing.assert_allclose(array_of(op(p, 8), column), array_of(op(p.repartition(7), 256), column), atol=1e-9)


def test_flat_and_spike(plane_of, array_of):
    assert np.abs(array_of(st.sobel(plane_of(np.full((5, 5), 42.0))), "mag")).max() == 0
    spike = np.zeros((7, 7))
    spike[3, 3] = 100
    out = array_of(st.gaussian_blur(plane_of(spike), 1.0), "blur")
    assert abs(out.sum() - 100) < 1e-6 and out[3, 3] < 100


def test_normalize(plane_of):
    df = normalize(plane_of(np.array([[10.0, 20, 30, 40]]), np.full((1, 3), 7.0)), ("image_id", "ch"))
    assert [r.norm for r in df.where("image_id = 1").collect()] == [0.0] * 3
    got = [r.norm for r in df.where("image_id = 0").orderBy("x").collect()]
    np.testing.assert_allclose(got, [0, 1 / 3, 2 / 3, 1])


def test_order_statistic_matches_sort(plane_of):
    row = order_statistic(plane_of(NOISE), ("image_id", "ch"), "v", {"a": 0.05, "b": 0.5, "c": 0.95}, buckets=4).first()
    s = np.sort(NOISE.ravel())
    assert (row.a, row.b, row.c) == tuple(s[int(s.size * p)] for p in (0.05, 0.5, 0.95))


@pytest.mark.parametrize("overlap", [False, True])
def test_block_round_trip(plane_of, array_of, overlap):
    y, x = np.mgrid[0:37, 0:45]
    img = 50 + 100 * y / 64 + 30 * np.sin(np.pi * x / 8)
    out = bl.block_synthesize(bl.block_analyze(plane_of(img), 16, overlap), overlap)
    np.testing.assert_allclose(array_of(out, "v"), img, atol=1e-8)


def test_variable_blocks(plane_of, array_of):
    y, x = np.mgrid[0:128, 0:128]
    img = np.where((y < 64) & (x < 64), 128 + 10 * y / 64, 100 + 50 * np.sin(np.pi * y / 4) + 30 * np.cos(np.pi * x / 3))
    p = plane_of(img)
    out = bl.variable_synthesize(bl.variable_analyze(p, bl.classify_blocks(p, 20.0)))
    np.testing.assert_allclose(array_of(out, "v"), img, atol=1e-8)


def test_channel_prediction(spark):
    l = [1.0, -1, 2, -2, 3, -3]
    mk = lambda b, v: [(0, 0, b, 0, i + 1, float(c)) for i, c in enumerate(v)]
    schema = "image_id long, gy int, gx int, u int, w int, c double"
    luma = spark.createDataFrame(mk(0, l) + mk(1, [1, 0, -1, 0]) + mk(2, [0] * 4), schema)
    side = spark.createDataFrame(mk(0, [v / 2 for v in l]) + mk(1, [0, 1, 0, -1]) + mk(2, [1, -1, .5, -.5]), schema)
    got = {r.gx: (r.alpha, r.used) for r in bl.channel_prediction(luma, side).select("gx", "alpha", "used").distinct().collect()}
    assert got == {0: (0.5, True), 1: (0.0, False), 2: (0.0, False)}


def test_scene_classes(plane_of):
    y, x = np.mgrid[0:128, 0:128]
    imgs = [100 + 40 * (x // 16 % 2), np.full((128, 128), 90.0)]
    got = {r.image_id: r.scene for r in scene_class(plane_of(*imgs)).collect()}
    assert got == {0: "Architectural", 1: "Flat"}


@pytest.mark.parametrize("shape", [(10, 15), (1, 1), (3, 7)])
def test_covering_order_is_a_permutation(plane_of, shape):
    ranks = sorted(r.rank for r in covering_order(plane_of(np.zeros(shape)), chunk=16).collect())
    assert ranks == list(range(shape[0] * shape[1]))


def _lcg(n, seed):
    out = []
    for _ in range(n):
        seed = seed * 48271 % 2147483647
        out.append(seed)
    return out


def test_runs_and_entropy(spark):
    vals = [0 if v % 100 < 90 else 1 for v in _lcg(5000, 7777)]
    df = spark.createDataFrame([(0, i, v, 0) for i, v in enumerate(vals)], "stream_id long, pos long, sym int, bucket int")
    n = df.groupBy("stream_id").agg(F.count("*").alias("n"))
    back = sq.expand_runs(sq.run_levels(df, chunk=64), n).orderBy("pos").toPandas()
    assert back.sym.tolist() == vals
    p = np.mean(vals)
    h = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
    assert abs(sq.entropy(df, ["stream_id"], "sym").first().entropy - h) < 1e-9


def test_components_match_flood_fill(plane_of, array_of):
    mask = RNG.random((40, 70)) < 0.45
    p = plane_of(mask.astype(float)).where("v > 0").select("image_id", "ch", "y", "x")
    got = gs.connected_components(p).toPandas()
    want, label = np.full(mask.shape, -1), 0
    for y, x in zip(*np.nonzero(mask)):
        if want[y, x] < 0:
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 40 and 0 <= b < 70 and mask[a, b] and want[a, b] < 0:
                    want[a, b] = label
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            label += 1
    assert (want[got.y, got.x] == got.comp).all() and len(got) == mask.sum()


def _cluster(spark, pts):
    return spark.createDataFrame([(0, 0, int(y), int(x), 0, 3.0, i) for i, (y, x) in enumerate(pts)], "image_id long, ch int, y int, x int, comp long, e double, i long")


def test_segment_and_arc_fits(spark):
    s = gs.fit_segments(_cluster(spark, [(5, x) for x in range(10)])).first()
    assert (s.x1, s.y1, s.x2, s.y2) == (0, 5, 9, 5)
    t = np.linspace(0, math.pi, 60)
    pts = sorted({(round(50 + 20 * math.sin(a)), round(50 + 20 * math.cos(a))) for a in t})
    a = gs.fit_arcs(_cluster(spark, pts)).first()
    assert abs(a.cx - 50) <= 1 and abs(a.cy - 50) <= 1 and abs(a.radius - 20) <= 1


def test_rendered_line_matches_stepping(spark):
    def walk(x1, y1, x2, y2):
        dx, dy = abs(x2 - x1), abs(y2 - y1)
        sx, sy, err, out = (1 if x2 > x1 else -1), (1 if y2 > y1 else -1), dx - dy, []
        while True:
            out.append((y1, x1))
            if (x1, y1) == (x2, y2):
                return set(out)
            e2 = 2 * err
            if e2 > -dy:
                err, x1 = err - dy, x1 + sx
            if e2 < dx:
                err, y1 = err + dx, y1 + sy
    lines = [(0, 0, 9, 4), (3, 20, 7, 2), (12, 5, 1, 5), (6, 6, 0, 11)]
    rows = [(i, 0, i, "segment", *l, None, None, None, None, None, 5, 20) for i, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "image_id long, ch int, prim_id long, kind string, x1 int, y1 int, x2 int, y2 int, cx int, cy int, radius int, ts int, te int, amp int, phase int")
    got = gs.render_primitives(df).toPandas()
    for i, l in enumerate(lines):
        assert set(map(tuple, got[got.image_id == i][["y", "x"]].to_numpy())) == walk(*l)


def test_patches_fit_quadratics(plane_of, array_of):
    y, x = np.mgrid[0:32, 0:32] / 31.0
    img = 3 + 20 * x - 7 * y + 5 * x * y + 9 * x * x - 4 * y * y
    out = pt.fit_patches(plane_of(img), 1.0)
    assert out.agg(F.max("rmse")).first()[0] < 1e-8
    np.testing.assert_allclose(array_of(pt.render_patches(out), "v"), img, atol=1e-8)


def test_wiener_matches_fft(plane_of, array_of):
    z = np.fft.fft2(NOISE)
    p = np.abs(z) ** 2 / NOISE.size
    want = np.clip(np.fft.ifft2(z * (np.maximum(p - 900.0, 0) / (p + 1e-10))).real, 0, 255)
    np.testing.assert_allclose(array_of(fl.wiener_denoise(plane_of(NOISE), 30.0), "out"), want, atol=1e-8)


def test_bd_rate_equals_polynomial_fits(spark):
    """A scaled curve, random curves against numpy, and curves without a rate."""
    rng, rows, want = np.random.default_rng(2), [], {}
    for i in range(12):
        n = 5 if i == 0 else int(rng.integers(4, 9))
        ra, rb = np.sort(rng.uniform(0.1, 4, (2, n)), axis=1)
        pa, pb = np.sort(rng.uniform(25, 45, (2, n)), axis=1)
        if i == 0:
            rb, pb = ra / 0.9, pa
        lo, hi = max(pa.min(), pb.min()), min(pa.max(), pb.max())
        area = [np.diff(np.polyval(np.polyint(np.polyfit(p, np.log(r), 3)), [lo, hi]))[0] for r, p in ((ra, pa), (rb, pb))]
        want[i] = (np.exp((area[0] - area[1]) / (hi - lo)) - 1) * 100 if hi > lo else None
        rows += [(i, q, c, float(r[q]), float(p[q])) for c, r, p in (("a", ra, pa), ("b", rb, pb)) for q in range(n)]
    rows += [(90, q, c, 1.0 + q, 30.0 + q) for c in "ab" for q in range(3)]  # three points
    rows += [(91, q, c, 1.0 + q, 30.0 + q // 4) for c in "ab" for q in range(8)]  # two qualities
    rows += [(92, q, c, 1.0 + q, 30.0 + q + 20 * (c == "b")) for c in "ab" for q in range(8)]  # nothing in common
    rows += [(93, q, c, 0.0 + q, 30.0 + q) for c in "ab" for q in range(8)]  # a zero rate
    got = {r.image_id: r.bd_rate for r in ql.bd_rate(spark.createDataFrame(rows, "image_id long, q int, codec string, bpp double, psnr double"), "a", "b").collect()}
    assert abs(got[0] + 10.0) < 1e-6 and all(got[i] is None for i in (90, 91, 92, 93))
    assert all(got[i] is None if v is None else abs(got[i] - v) < 1e-6 * max(1, abs(v)) for i, v in want.items())


def test_small_systems_are_solved_with_pivots(spark):
    from gridloom.functions.linear import solve

    rng, rows = np.random.default_rng(5), []
    for k in range(30):
        b = rng.normal(size=(9, 4)) * 10.0 ** rng.integers(-3, 4)
        rows.append((k, np.column_stack([b.T @ b, rng.normal(size=4)])[rng.permutation(4)]))
    df = spark.createDataFrame([(k, m.tolist()) for k, m in rows], "k int, m array<array<double>>")
    got = {r.k: r.x for r in df.select("k", solve(F.col("m"), 4).alias("x")).collect()}
    for k, m in rows:
        np.testing.assert_allclose(got[k], np.linalg.solve(m[:, :4], m[:, 4]), rtol=1e-6)
    flat = spark.createDataFrame([([[2.0, 0.0, 4.0], [0.0, 0.0, 0.0]],)], "m array<array<double>>")
    assert flat.select(solve(F.col("m"), 2).alias("x")).first().x == [2.0, 0.0]


def test_coefficient_choice_limits(spark):
    df = spark.createDataFrame([(i, float(c), int(abs(c) / 10 + 0.28) * (1 if c >= 0 else -1)) for i, c in enumerate((3, -14, 27, 55, -91))], "i int, c double, k int")
    df = df.withColumn("pos_step", F.lit(10.0))
    zero = ql.coefficient_choice(df, ["i"], F.lit(0.7), F.lit(0.4), 1e9).toPandas()
    assert (zero.chosen.abs() == zero.k.abs().map(lambda k: 0 if k <= 4 else k - 1)).all()
    free = ql.coefficient_choice(df, ["i"], F.lit(0.7), F.lit(0.4), 0.0).toPandas()
    assert ((free.c - 10 * free.chosen).abs() <= (free.c - 10 * free.k).abs() + 1e-9).all()


def _png(path, rgb):
    h, w, _ = rgb.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_and_header_sources(spark, tmp_path):
    from gridloom.sources import list_images, read_images, scan_codec_files, write_planes

    rgb = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    _png(tmp_path / "a.png", rgb)
    px = read_images(spark, str(tmp_path)).toPandas()
    for r in px.itertuples():
        assert (r.r, r.g, r.b) == tuple(rgb[r.y, r.x])
    assert len(px) == 35 and list_images(spark, str(tmp_path)).count() == 1
    (tmp_path / "ok.aur").write_bytes(b"AUR2" + struct.pack("<BBHHBf6f", 12, 50, 64, 32, 0, 7.5, *range(6)) + bytes(61))
    (tmp_path / "bad.aur").write_bytes(b"nope")
    got = {r.path[-6:]: r for r in scan_codec_files(spark, str(tmp_path)).collect()}
    assert got["ok.aur"].ok and got["ok.aur"].width == 64 and abs(got["ok.aur"].bpp - 800 / 2048) < 1e-12
    assert not got["ad.aur"].ok and got["ad.aur"].version is None
    plane = spark.range(20).selectExpr("id div 10 image_id", "0 ch", "cast(id % 10 as int) y", "0 x", "double(id) v")
    write_planes(plane, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("v")).first()[0] == 190.0


def test_stream_equals_batch_fold():
    from gridloom.streaming.profiles import advance

    syms = [v % 7 - 3 for v in _lcg(200, 11)]
    start = (0, 0, 0, 14000, 12000, 0.0)
    assert advance(advance(start, syms[:77]), syms[77:]) == advance(start, syms)


def test_order_statistics_on_nested_scales(spark):
    from gridloom.operators.orderstat import order_statistic

    values = sorted([1e-12 * k for k in range(60)] + [1e-6 * k for k in range(60)] + [float(k) for k in range(40)] + [1e9] * 3)
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0)] * 4 + [(3, None)], "g int, v double")
    got = {r.g: r for r in order_statistic(df, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, buckets=16, most=2).collect()}
    assert [got[1][k] for k in ("low", "mid", "top")] == [values[min(int(len(values) * p), len(values) - 1)] for p in (0.1, 0.5, 1.0)]
    assert got[1].n == len(values) and (got[2].low, got[2].top, got[2].n) == (5.0, 5.0, 4) and 3 not in got


def test_z_order_of_sides_over_sixteen_bits(spark):
    from pyspark.sql import functions as F

    from gridloom.operators.orders import morton_code

    cells = [(0, 70000), (70000, 0), (1, 1 << 30), (65536, 65536), (3, 5)]
    got = [r.z for r in spark.createDataFrame(cells, "y int, x int").select(morton_code(F.col("y"), F.col("x")).alias("z")).collect()]
    assert got == [sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(31)) for y, x in cells]


def test_edge_strips_one_pixel_wide_get_patches(spark, plane_of, array_of):
    img = np.add.outer(np.arange(17.0), 2 * np.arange(33.0))
    out = pt.fit_patches(plane_of(img), 1.0)
    np.testing.assert_allclose(array_of(pt.render_patches(out), "v"), img, atol=1e-8)
