"""Registry, inputs and the small SQL text builder used by the query catalog."""

import os
from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.color import gct_forward
from gridloom.operators.blocks import block_analyze, coefficients
from gridloom.operators.orderstat import dense_position
from gridloom.operators.orders import zigzag_table
from gridloom.functions.quant import deadzone_quantize
from gridloom.session import bound_tasks
from gridloom.sources.grids import grid_from_events, plane_from_arrays, rgb_from_arrays


class Inputs:
    """The catalog's input tables, derived from one data folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def plane(self):
        """Each embedding is an 8x8 tile of a 32x40 image."""
        return plane_from_arrays(self.table("embeddings"), "vec_id", "embedding")

    def pixels(self):
        return rgb_from_arrays(self.table("embeddings"), "vec_id", "embedding")

    def chroma(self):
        lum, c1, c2 = gct_forward(F.col("r"), F.col("g"), F.col("b"))
        return self.pixels().select("image_id", F.lit(0).alias("ch"), "y", "x", lum.alias("v"), c1.alias("c1"), c2.alias("c2"), "h", "w")

    def activity(self):
        """Value by hour and day of month, one image per event type."""
        e = self.table("events").withColumn("value", F.col("value").cast("decimal(12,2)"))
        kinds = F.ascii("event_type")  # the types start with different letters
        g = grid_from_events(e, kinds, F.hour("ts"), F.dayofmonth("ts") - 1, F.col("value"), 30)
        return g.withColumn("v", F.col("v").cast("double"))

    def ship(self):
        """Quantity by month and day of month, one image per supplier."""
        li = self.table("lineitem")
        months = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
        return grid_from_events(li, F.col("l_suppkey"), months, F.dayofmonth("l_shipdate") - 1, F.col("l_quantity"), 31)

    def symbols(self, step=40.0):
        """Quantised block spectra in zigzag order; a stream is one block."""
        co = coefficients(block_analyze(self.plane(), 8)).withColumn("c", F.round("c", 9))
        co = co.join(F.broadcast(zigzag_table(self.spark, (8,))), ["bs", "u", "w"])
        stream = F.col("image_id") * 20 + F.col("gy") * 5 + F.col("gx")
        return co.select(
            stream.alias("stream_id"), F.col("zz").cast("long").alias("pos"),
            deadzone_quantize(F.col("c"), F.lit(step), F.lit(0.22)).alias("sym"), F.pmod(stream, F.lit(4)).cast("int").alias("bucket"),
        )

    def event_symbols(self):
        """Long streams: events per user in order of arrival."""
        e = self.table("events").select(
            F.col("user_id").alias("stream_id"), "event_id", (F.floor("value") % 7 - 3).cast("int").alias("sym"),
            (F.col("user_id") % 4).cast("int").alias("bucket"),
        )
        return dense_position(e, ["stream_id"], "event_id", "pos").drop("event_id")

    def pairs(self):
        p = self.plane()
        return p.select("image_id", "ch", "y", "x", F.col("v").alias("v_orig"), (8.0 * F.floor(F.col("v") / 8 + 0.5)).alias("v_dec"))

    def rgb_pairs(self):
        p = self.pixels()
        worse = lambda c: F.least(16 * F.floor(F.col(c) / 16 + 0.5), F.lit(255)).cast("int").alias(c + "2")
        return p.select("image_id", "y", "x", "r", "g", "b", *[worse(c) for c in "rgb"])


class Sql:
    """Collects WITH clauses; every helper returns the name of a relation."""

    PX = "image_id, ch, y, x"

    def __init__(self):
        self.parts, self.names, self.recursive = [], {}, False

    def cte(self, body, hint="t", recursive=False, columns=""):
        if body in self.names:
            return self.names[body]
        name = f"{hint}_{len(self.parts)}"
        self.recursive |= recursive
        self.parts.append(f"{name}{columns} AS ({body.replace('@self', name)})")
        self.names[body] = name
        return name

    def text(self, final):
        if not self.parts:
            return final
        return f"WITH {'RECURSIVE ' if self.recursive else ''}" + ",\n".join(self.parts) + "\n" + final

    # ---- inputs -------------------------------------------------------
    def plane(self):
        return self.cte(
            "SELECT vec_id // 20 AS image_id, 0 AS ch, ((vec_id % 20) // 5) * 8 + i // 8 AS y, ((vec_id % 20) % 5) * 8 + i % 8 AS x, "
            "floor(least(greatest(127.5 + 255.0 * embedding[i + 1]::DOUBLE, 0.0), 255.0) + 0.5) AS v "
            "FROM embeddings, unnest(range(64)) AS r(i)", "plane")

    def pixels(self):
        raw = self.cte(
            "SELECT vec_id, i, floor(least(greatest(127.5 + 255.0 * embedding[i + 1]::DOUBLE, 0.0), 255.0) + 0.5) AS a, "
            "floor(least(greatest(127.5 + 255.0 * embedding[(i + 21) % 64 + 1]::DOUBLE, 0.0), 255.0) + 0.5) AS b, "
            "floor(least(greatest(127.5 + 255.0 * embedding[(i + 42) % 64 + 1]::DOUBLE, 0.0), 255.0) + 0.5) AS c "
            "FROM embeddings, unnest(range(64)) AS r(i)", "raw")
        return self.cte(
            "SELECT vec_id // 20 AS image_id, ((vec_id % 20) // 5) * 8 + i // 8 AS y, ((vec_id % 20) % 5) * 8 + i % 8 AS x, "
            f"a AS r, floor((a + b) / 2) AS g, floor((a + 3 * c) / 4) AS b FROM {raw}", "pixels")

    def chroma(self):
        p = self.pixels()
        lum = self.cte(
            f"SELECT image_id, 0 AS ch, y, x, r, b, (r + 1.618033988749895::DOUBLE * g + 0.6180339887498949::DOUBLE * b) * (1.0 / (2.0 * 1.618033988749895::DOUBLE)) AS v FROM {p}", "lum")
        return self.cte(f"SELECT image_id, ch, y, x, v, b - v AS c1, r - v AS c2 FROM {lum}", "chroma")

    def _dense(self, facts, w):
        h = self.cte(f"SELECT max(y) + 1 AS h FROM {facts}", "h")
        return self.cte(
            f"SELECT m.image_id, 0 AS ch, a.y, b.x, coalesce(f.v, 0)::DOUBLE AS v FROM (SELECT DISTINCT image_id FROM {facts}) m "
            f"CROSS JOIN (SELECT unnest(range((SELECT h FROM {h}))) AS y) a CROSS JOIN (SELECT unnest(range({w})) AS x) b "
            f"LEFT JOIN {facts} f ON f.image_id = m.image_id AND f.y = a.y AND f.x = b.x", "grid")

    def activity(self):
        f = self.cte(
            "SELECT ascii(event_type) AS image_id, hour(ts) AS y, day(ts) - 1 AS x, sum(value::DECIMAL(12,2)) AS v FROM events GROUP BY ALL", "facts")
        return self._dense(f, 30)

    def ship(self):
        f = self.cte(
            "SELECT l_suppkey AS image_id, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS y, day(l_shipdate) - 1 AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL", "facts")
        return self._dense(f, 31)

    def symbols(self, step=40.0):
        co = self.dct(self.plane(), 8)
        zz = self.zigzag((8,))
        return self.cte(
            f"SELECT image_id * 20 + gy * 5 + gx AS stream_id, zz AS pos, {self.deadzone(f'round(c, 9)', f'{step}::DOUBLE', '0.22::DOUBLE')} AS sym, "
            f"(image_id * 20 + gy * 5 + gx) % 4 AS bucket FROM {co} JOIN {zz} USING (u, w)", "symbols")

    def event_symbols(self):
        return self.cte(
            "SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, "
            "(floor(value)::BIGINT % 7 - 3) AS sym, user_id % 4 AS bucket FROM events", "evsym")

    def pairs(self):
        return self.cte(f"SELECT image_id, ch, y, x, v AS v_orig, 8.0 * floor(v / 8 + 0.5) AS v_dec FROM {self.plane()}", "pairs")

    def rgb_pairs(self):
        w = ", ".join(f"least(16 * floor({c} / 16 + 0.5), 255) AS {c}2" for c in "rgb")
        return self.cte(f"SELECT *, {w} FROM {self.pixels()}", "rgbp")

    # ---- building blocks ---------------------------------------------
    @staticmethod
    def deadzone(c, step, dz):
        lev = f"floor(abs({c}) / ({step}) + 0.5 - ({dz}))"
        return f"(CASE WHEN {lev} <= 0 THEN 0 WHEN {c} >= 0 THEN {lev} ELSE -{lev} END)::BIGINT"

    @staticmethod
    def rha(v):
        """Round half away from zero."""
        return f"(CASE WHEN {v} >= 0 THEN floor({v} + 0.5) ELSE -floor(0.5 - ({v})) END)"

    @staticmethod
    def clamp(v, lo, hi):
        return f"least(greatest({v}, {lo}), {hi})"

    def extent(self, src):
        return self.cte(f"SELECT image_id, ch, max(y) + 1 AS h, max(x) + 1 AS w FROM {src} GROUP BY ALL", "ext")

    def ring(self, src, v="v"):
        """All columns plus n00..n22."""
        a = self.cte(f"SELECT *, lag({v}) OVER r AS _a, {v} AS _b, lead({v}) OVER r AS _c FROM {src} WINDOW r AS (PARTITION BY image_id, ch, y ORDER BY x)", "row3")
        w = "PARTITION BY image_id, ch, x ORDER BY y"
        return self.cte(
            f"SELECT * EXCLUDE (_a, _b, _c), lag(_a) OVER c AS n00, lag(_b) OVER c AS n01, lag(_c) OVER c AS n02, _a AS n10, _b AS n11, _c AS n12, "
            f"lead(_a) OVER c AS n20, lead(_b) OVER c AS n21, lead(_c) OVER c AS n22 FROM {a} WINDOW c AS ({w})", "ring")

    def fdiff(self, src, v="v"):
        return self.cte(
            f"SELECT *, greatest(abs(dx), abs(dy)) AS g FROM (SELECT *, coalesce(lead({v}) OVER (PARTITION BY image_id, ch, y ORDER BY x) - {v}, 0.0) AS dx, "
            f"coalesce(lead({v}) OVER (PARTITION BY image_id, ch, x ORDER BY y) - {v}, 0.0) AS dy FROM {src})", "fdiff")

    SOBEL_X = "n02 + 2.0 * n12 + n22 - n00 - 2.0 * n10 - n20"
    SOBEL_Y = "n20 + 2.0 * n21 + n22 - n00 - 2.0 * n01 - n02"

    def sobel(self, src, v="v"):
        r = self.ring(src, v)
        return self.cte(
            f"SELECT image_id, ch, y, x, sqrt(gx * gx + gy * gy) AS mag, atan2(gy, gx) AS angle, {v} FROM (SELECT *, "
            f"CASE WHEN n00 IS NOT NULL AND n22 IS NOT NULL THEN ({self.SOBEL_X}) / 4.0 ELSE (coalesce(n12, {v}) - coalesce(n10, {v})) * 0.5 END AS gx, "
            f"CASE WHEN n00 IS NOT NULL AND n22 IS NOT NULL THEN ({self.SOBEL_Y}) / 4.0 ELSE (coalesce(n21, {v}) - coalesce(n01, {v})) * 0.5 END AS gy FROM {r})", "sobel")

    def kernel(self, sigma, radius=None):
        from gridloom.operators.stencil import gaussian_weights

        radius, w = gaussian_weights(sigma, radius)
        rows = ", ".join(f"({k}, {wt!r}::DOUBLE)" for k, wt in zip(range(-radius, radius + 1), w))
        return self.cte(f"SELECT * FROM (VALUES {rows}) AS t(k, wt)", "kern")

    @staticmethod
    def border(i, n, mode):
        if mode == "clamp":
            return f"least(greatest({i}, 0), {n} - 1)"
        return f"(CASE WHEN {i} < 0 THEN least(-({i}), {n} - 1) WHEN {i} >= {n} THEN greatest(2 * ({n} - 1) - ({i}), 0) ELSE {i} END)"

    def blur(self, src, sigma, v="v", mode="clamp", radius=None):
        k, e = self.kernel(sigma, radius), self.extent(src)
        h = self.cte(
            f"SELECT p.image_id, p.ch, p.y, p.x, sum(s.{v} * k.wt) AS _h FROM {src} p JOIN {e} e USING (image_id, ch) CROSS JOIN {k} k "
            f"JOIN {src} s ON s.image_id = p.image_id AND s.ch = p.ch AND s.y = p.y AND s.x = {self.border('p.x + k.k', 'e.w', mode)} GROUP BY ALL", "blurh")
        return self.cte(
            f"SELECT p.image_id, p.ch, p.y, p.x, sum(s._h * k.wt) AS blur FROM {h} p JOIN {e} e USING (image_id, ch) CROSS JOIN {k} k "
            f"JOIN {h} s ON s.image_id = p.image_id AND s.ch = p.ch AND s.x = p.x AND s.y = {self.border('p.y + k.k', 'e.h', mode)} GROUP BY ALL", "blur")

    def stat(self, src, v, ps, keys="image_id, ch"):
        cols = ", ".join(f"list_sort(list({v}))[least(floor(count({v}) * {p}::DOUBLE)::BIGINT, count({v}) - 1) + 1] AS {n}" for n, p in ps.items())
        return self.cte(f"SELECT {keys}, count({v}) AS n, {cols} FROM {src} WHERE {v} IS NOT NULL GROUP BY {keys}", "stat")

    def zigzag(self, sizes=(8, 16, 32)):
        rows = ", ".join(f"({b})" for b in sizes)
        return self.cte(
            f"SELECT bs, u, w, row_number() OVER (PARTITION BY bs ORDER BY u + w, CASE WHEN (u + w) % 2 = 0 THEN -u ELSE u END) - 1 AS zz FROM "
            f"(VALUES {rows}) AS b(bs), unnest(range(bs)) AS r(u), unnest(range(bs)) AS s(w) WHERE u + w > 0", "zz")

    def dct(self, src, bs, v="v"):
        """Whole blocks only: (image_id, ch, gy, gx, u, w, c)."""
        f = self.cte(f"SELECT k, i, cos(pi() / {bs} * (i + 0.5) * k) AS f FROM unnest(range({bs})) AS a(k), unnest(range({bs})) AS b(i)", "basis")
        rows = self.cte(
            f"SELECT image_id, ch, y // {bs} AS gy, x // {bs} AS gx, y % {bs} AS r, k AS w, sum({v} * f) AS t FROM {src} JOIN {f} ON i = x % {bs} GROUP BY ALL", "dctr")
        return self.cte(f"SELECT image_id, ch, gy, gx, k AS u, w, sum(t * f) AS c FROM {rows} JOIN {f} ON i = r GROUP BY ALL", "dct")

    def block_mean(self, src, bs, v="v"):
        return self.cte(f"SELECT image_id, ch, y // {bs} AS y, x // {bs} AS x, avg({v}) AS v FROM {src} GROUP BY ALL", "bmean")

    def normalize(self, src, v="v", rule="unit", name="norm"):
        m = self.cte(f"SELECT image_id, ch, min({v}) AS lo, max({v}) AS hi FROM {src} GROUP BY ALL", "mm")
        e = {
            "unit": f"CASE WHEN hi - lo > 2.220446049250313e-16 THEN ({v} - lo) / (hi - lo) ELSE 0.0 END",
            "byte": f"({v} - lo) * 255.0 / greatest(hi - lo, 1e-6)",
            "byte_flat": f"({v} - lo) * 255.0 / CASE WHEN hi - lo < 1e-6 THEN 1.0 ELSE hi - lo END",
        }[rule]
        return self.cte(f"SELECT s.*, {e} AS {name} FROM {src} s JOIN {m} USING (image_id, ch)", "norm")

    def maxdiff(self, src, v="v"):
        return self.cte(
            f"SELECT image_id, ch, y, x, {v}, coalesce(greatest(abs(n01 - {v}), abs(n21 - {v}), abs(n10 - {v}), abs(n12 - {v})), 0.0) AS grad FROM {self.ring(src, v)}", "mxd")

    def field(self, grid, sigma=1.5, ratio=2.618033988749895, k=0.5):
        e = self.cte(f"SELECT image_id, ch, y, x, mag AS e FROM {self.sobel(grid)}", "edge")
        a, i = self.blur(e, sigma, "e"), self.blur(e, sigma * ratio, "e")
        d = self.cte(f"SELECT image_id, ch, y, x, greatest(a.blur - i.blur, 0.0) AS dog, i.blur AS inh FROM {a} a JOIN {i} i USING (image_id, ch, y, x)", "dog")
        s = self.sobel(d, "inh")
        n = self.normalize(d, "dog", "unit", "t")
        return self.cte(f"SELECT image_id, ch, y, x, t, power(1.618033988749895::DOUBLE, -{k} * t) AS step_mod, s.mag AS grad, s.angle FROM {n} JOIN {s} s USING (image_id, ch, y, x)", "field")

    def strength(self, field):
        m = self.cte(f"SELECT image_id, ch, greatest(max(grad), 1e-6) AS top FROM {field} GROUP BY ALL", "top")
        return self.cte(f"SELECT f.*, grad / top AS strength FROM {field} f JOIN {m} USING (image_id, ch)", "strg")

    def foveal(self, grid, k=1.5):
        g = self.cte(f"SELECT *, grad / (abs(v) + 10.0) AS weber FROM {self.maxdiff(grid)}", "web")
        m = self.cte(f"SELECT image_id, ch, greatest(max(weber), 1e-6) AS top FROM {g} GROUP BY ALL", "top")
        return self.cte(
            f"SELECT image_id, ch, y, x, power(1.618033988749895::DOUBLE, -{k} * (0.6 * least(weber / top, 1.0) + 0.4 * (1.0 - least(greatest(v / 255.0, 0.0), 1.0)))) AS foveal FROM {g} JOIN {m} USING (image_id, ch)", "fov")

    def complexity(self, src):
        d = self.fdiff(src)
        return self.cte(
            f"SELECT image_id, ch, c AS complexity, least(greatest((c - 6.0) / 5.0, 0.0), 1.0) AS c_norm FROM (SELECT image_id, ch, "
            f"log2(sum(dy * dy) / greatest(max(y) * (max(x) + 1), 1) + sum(dx * dx) / greatest((max(y) + 1) * max(x), 1) + 1.0) AS c FROM {d} GROUP BY image_id, ch)", "cplx")

    def scene(self, grid):
        d = self.cte(f"SELECT *, sqrt(dx * dx + dy * dy) AS mag, atan2(dy, dx) AS ang FROM {self.fdiff(grid)}", "dmag")
        b = self.cte(f"SELECT *, least(floor((CASE WHEN ang < 0 THEN ang + pi() WHEN ang >= pi() THEN ang - pi() ELSE ang END) / pi() * 4), 3) AS bin FROM {d}", "dbin")
        hs = ", ".join(f"sum(CASE WHEN bin = {i} AND mag >= 1.0 THEN mag ELSE 0.0 END) AS h{i}" for i in range(4))
        g = self.cte(f"SELECT image_id, ch, count(*) AS n, 100.0 * count(*) FILTER (mag < 3.0) / count(*) AS smooth, {hs} FROM {b} GROUP BY image_id, ch", "sc")
        ps = ", ".join(f"CASE WHEN h0 + h1 + h2 + h3 > 0 THEN h{i} / (h0 + h1 + h2 + h3) ELSE 0.0 END AS p{i}" for i in range(4))
        p = self.cte(f"SELECT *, {ps} FROM {g}", "sp")
        ent = " + ".join(f"CASE WHEN p{i} > 0 THEN -p{i} * ln(p{i}) ELSE 0.0 END" for i in range(4))
        a = self.cte(f"SELECT *, 1.0 - ({ent}) / ln(4.0) AS an, p0 + p2 AS hv FROM {p}", "sa")
        s = self.cte(
            f"SELECT *, CASE WHEN n < 4 OR smooth > 50 THEN 'Flat' WHEN hv > 0.6 AND an > 0.1 THEN 'Architectural' WHEN an > 0.15 THEN 'Perspective' "
            f"WHEN smooth < 15 THEN 'Organic' ELSE 'Mixed' END AS scene FROM {a}", "ss")
        return self.cte(
            f"SELECT image_id, ch, scene, CASE WHEN n < 4 THEN 100.0 ELSE smooth END AS smooth_pct, CASE WHEN n < 4 THEN 0.0 ELSE an END AS anisotropy, "
            f"CASE WHEN n < 4 THEN 1.0 ELSE CASE scene WHEN 'Flat' THEN 1.5 WHEN 'Architectural' THEN 1.0 WHEN 'Perspective' THEN 0.9 WHEN 'Organic' THEN 0.5 ELSE 0.8 END END AS velvet, "
            f"CASE scene WHEN 'Flat' THEN 0.9 WHEN 'Architectural' THEN 1.0 WHEN 'Perspective' THEN 0.95 WHEN 'Organic' THEN 1.1 ELSE 1.0 END AS step_factor, "
            f"CASE scene WHEN 'Flat' THEN 1.5 WHEN 'Architectural' THEN 1.0 WHEN 'Perspective' THEN 0.9 WHEN 'Organic' THEN 0.5 ELSE 0.8 END AS deblock, "
            f"scene <> 'Flat' OR (CASE WHEN n < 4 THEN 100.0 ELSE smooth END) < 85.0 AS lapped FROM {s}", "scene")

    def edge_class(self, grid):
        r = self.ring(grid)
        g = self.cte(
            f"SELECT *, sqrt(dx * dx + dy * dy) * (255.0 / (abs(v) + 25.0)) AS mag FROM (SELECT image_id, ch, y, x, v, (coalesce(n12, v) - coalesce(n10, v)) * 0.5 AS dx, "
            f"(coalesce(n21, v) - coalesce(n01, v)) * 0.5 AS dy FROM {r})", "cgrad")
        m = self.stat(g, "mag", {"med": 0.5})
        return self.cte(
            f"SELECT *, CASE WHEN kind = 'segment' THEN atan2(dy, dx) ELSE 0.0 END AS angle FROM (SELECT g.*, CASE WHEN mag < greatest(med, 0.5) * 0.5 THEN 'none' "
            f"WHEN greatest(abs(dx), abs(dy)) > least(abs(dx), abs(dy)) * 2.0 THEN 'segment' ELSE 'arc' END AS kind FROM {g} g JOIN {m} USING (image_id, ch))", "ecls")

    def resize(self, src, dims, v="v"):
        """``dims`` has (image_id, ch, th, tw)."""
        e = self.extent(src)
        t = self.cte(
            f"SELECT d.image_id, d.ch, y, x, h, w, y * (CASE WHEN th > 1 THEN (h - 1.0) / (th - 1.0) ELSE 0.0 END)::DOUBLE AS sy, x * (CASE WHEN tw > 1 THEN (w - 1.0) / (tw - 1.0) ELSE 0.0 END)::DOUBLE AS sx "
            f"FROM {dims} d JOIN {e} USING (image_id, ch), unnest(range(th)) AS a(y), unnest(range(tw)) AS b(x)", "tgt")
        i = self.cte(f"SELECT *, least(floor(sy)::BIGINT, h - 1) AS y0, least(floor(sx)::BIGINT, w - 1) AS x0 FROM {t}", "tgi")
        i = self.cte(f"SELECT *, least(y0 + 1, h - 1) AS y1, least(x0 + 1, w - 1) AS x1, sy - y0 AS dy, sx - x0 AS dx FROM {i}", "tgj")
        j = " ".join(f"JOIN {src} s{a}{b} ON s{a}{b}.image_id = t.image_id AND s{a}{b}.ch = t.ch AND s{a}{b}.y = t.y{a} AND s{a}{b}.x = t.x{b}" for a in "01" for b in "01")
        return self.cte(
            f"SELECT t.image_id, t.ch, t.y, t.x, s00.{v} * (1.0 - dy) * (1.0 - dx) + s01.{v} * (1.0 - dy) * dx + s10.{v} * dy * (1.0 - dx) + s11.{v} * dy * dx AS {v} FROM {i} t {j}", "rsz")

    def components(self, mask):
        """8-connected components; labels 0.. in raster order of first pixel."""
        m = self.cte(f"SELECT image_id, ch, y, x, y * 1000000 + x AS id FROM {mask}", "msk")
        e = self.cte(f"SELECT a.image_id, a.ch, a.id AS s, b.id AS d FROM {m} a CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) u CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx) v "
                     f"JOIN {m} b ON b.image_id = a.image_id AND b.ch = a.ch AND b.y = a.y + dy AND b.x = a.x + dx", "adj")
        r = self.cte(f"SELECT image_id, ch, id, id AS root FROM {m} UNION SELECT r.image_id, r.ch, e.d, r.root FROM @self r JOIN {e} e ON e.image_id = r.image_id AND e.ch = r.ch AND e.s = r.id WHERE r.root < e.d", "reach", True)
        l = self.cte(f"SELECT image_id, ch, id, min(root) AS root FROM {r} GROUP BY ALL", "lab")
        return self.cte(f"SELECT image_id, ch, id // 1000000 AS y, id % 1000000 AS x, dense_rank() OVER (PARTITION BY image_id, ch ORDER BY root) - 1 AS comp FROM {l}", "comp")


@dataclass
class Query:
    name: str
    spark: Callable
    sql: Optional[Callable]
    ints: list
    dbls: list
    strs: list
    bools: list
    digits: int


REGISTRY: dict[str, Query] = {}


def add(name, spark, sql=None, ints="", dbls="", strs="", bools="", digits=6):
    """Register a query.

    ``spark`` maps Inputs to a frame, ``sql`` maps a Sql builder to a relation
    name.  The column lists fix names and types of the result on both sides.
    """
    assert name not in REGISTRY, name
    REGISTRY[name] = Query(name, spark, sql, ints.split(), dbls.split(), strs.split(), bools.split(), digits)


def run(q: Query, spark, folder) -> DataFrame:
    bound_tasks(spark)
    df = q.spark(Inputs(spark, folder))
    return df.select(
        *[F.col(c).cast("long").alias(c) for c in q.ints], *[F.round(F.col(c).cast("double"), q.digits).alias(c) for c in q.dbls],
        *[F.col(c).cast("string").alias(c) for c in q.strs], *[F.col(c).cast("boolean").alias(c) for c in q.bools],
    )


def text(q: Query) -> str:
    s = Sql()
    rel = q.sql(s)
    cols = [f'"{c}"::BIGINT AS "{c}"' for c in q.ints] + [f'round("{c}"::DOUBLE, {q.digits}) + 0.0 AS "{c}"' for c in q.dbls]
    cols += [f'"{c}"::VARCHAR AS "{c}"' for c in q.strs] + [f'"{c}"::BOOLEAN AS "{c}"' for c in q.bools]
    return s.text(f"SELECT {', '.join(cols)} FROM {rel}")
