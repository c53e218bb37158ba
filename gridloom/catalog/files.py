"""Files written from the tables and read back: codec catalogue, decoded images, listings, laid-out planes."""

import uuid

from pyspark.sql import functions as F

from gridloom.catalog.base import add
from gridloom.functions.color import gct_forward
from gridloom.session import scratch_folder
from gridloom.sources.files import write_files
from gridloom.sources.sinks import read_window, write_planes, write_zordered
from gridloom.sources.images import codec_header, list_images, png, read_images, scan_codec_files

C = F.col
# every tenth file is cut short, another tenth has a wrong magic (or a broken chunk)
SHORT, WRONG = 3, 7
HIGH, WIDE = 32, 40  # frame of an image


def _folder(c):
    return f"{scratch_folder(c.spark)}/{uuid.uuid4().hex}"


def _image_facts(c):
    """One row per image: size, channel ranges and pixels as rows of packed colours; an image has 1,280 pixels."""
    lum, c1, c2 = gct_forward(C("r"), C("g"), C("b"))
    p = c.pixels().withColumns({"l": lum, "c1": c1, "c2": c2, "p": (C("r") * 65536 + C("g") * 256 + C("b")).cast("int")})
    lines = p.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "p"))).alias("line"), *[f(k).alias(f"{k}_{n}") for k in ("l", "c1", "c2") for n, f in (("min", F.min), ("max", F.max))])
    return lines.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("y", C("line.p").alias("p"), C("line.x").alias("x")))).alias("rows"),
        *[f(f"{k}_{n}").alias(f"{k}_{n}") for k in ("l", "c1", "c2") for n, f in (("min", F.min), ("max", F.max))])


def _codec_files(c):
    f = _image_facts(c)
    size = F.size("rows")
    head = codec_header(F.lit(12), C("image_id") % 101, F.size(C("rows")[0]["p"]), size, C("image_id") % 6, F.array(C("image_id") / 8 + 0.5, "l_min", "l_max", "c1_min", "c1_max", "c2_min", "c2_max"))
    whole = F.concat(head, F.encode(F.repeat(F.lit("x"), (C("image_id") % 50 + 10).cast("int")), "UTF-8"))
    kind = C("image_id") % 10
    content = F.when(kind == SHORT, F.substring(whole, 1, 20)).when(kind == WRONG, F.concat(F.lit(b"JUNK"), F.substring(whole, 5, 1000))).otherwise(whole)
    folder = _folder(c)
    write_files(f.select(F.concat(C("image_id").cast("string"), F.lit(".aur")).alias("name"), content.alias("content")), folder)
    return folder


def _codec_headers(c):
    """Catalogue joined with the images it was written from."""
    got = scan_codec_files(c.spark, _codec_files(c)).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.aur$", 1).cast("long"))
    tiles = c.plane().groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.sum("v").alias("total"))
    return tiles.join(got, "image_id")


RANGES = "l_min l_max c1_min c1_max c2_min c2_max"


def _codec_sql(q):
    facts = q.cte(
        "SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width, min(v) AS l_min, max(v) AS l_max, min(c1) AS c1_min, max(c1) AS c1_max, min(c2) AS c2_min, max(c2) AS c2_max "
        f"FROM {q.chroma()} GROUP BY image_id", "facts")
    tiles = q.cte(f"SELECT image_id, count(*) AS n_pixels, sum(v) AS total FROM {q.plane()} GROUP BY image_id", "tiles")
    f = q.cte(f"SELECT *, image_id % 10 NOT IN ({SHORT}, {WRONG}) AS ok, CASE WHEN image_id % 10 = {SHORT} THEN 20 ELSE 39 END AS bytes_read, "
              f"CASE WHEN image_id % 10 = {SHORT} THEN 20 ELSE 49 + image_id % 50 END AS length FROM {facts} JOIN {tiles} USING (image_id)", "files")
    when = lambda e: f"CASE WHEN ok THEN {e} END"
    ranges = ", ".join(f"{when(f'{r}::FLOAT::DOUBLE')} AS {r}" for r in RANGES.split())
    return q.cte(
        f"SELECT image_id, n_pixels, total, ok, length, bytes_read, {when('12')} AS version, {when('image_id % 101')} AS quality, {when('width')} AS width, {when('height')} AS height, "
        f"{when('image_id % 6')} AS levels, {when('(image_id / 8 + 0.5)::FLOAT::DOUBLE')} AS step, {ranges}, {when('length * 8.0 / (width * height)')} AS bpp, {when('width * height * 3.0 / length')} AS ratio "
        f"FROM (SELECT * EXCLUDE ({', '.join(RANGES.split())}), {', '.join(RANGES.split())} FROM {f})")


add("codec_headers", _codec_headers, _codec_sql, "image_id n_pixels length bytes_read version quality width height levels", "total step bpp ratio " + RANGES, bools="ok")
add("codec_headers_long", lambda c: scan_codec_files(c.spark, _codec_files(c)).where("length >= 60").withColumn("image_id", F.regexp_extract("path", r"(\d+)\.aur$", 1).cast("long")),
    lambda q: q.cte(f"SELECT image_id, ok, length, bytes_read FROM {_codec_sql(q)} WHERE length >= 60"), "image_id length bytes_read", bools="ok")


def _png_files(c):
    f = _image_facts(c)
    # An image that lacks tiles has clear pixels there.
    cells = F.map_from_entries(F.flatten(F.transform("rows", lambda r: F.zip_with(r["x"], r["p"], lambda x, p: F.struct(r["y"] * WIDE + x, p)))))
    side = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    filled = F.transform(side(HIGH), lambda y: F.transform(side(WIDE), lambda x: F.coalesce(F.try_element_at("_cells", y * WIDE + x), F.lit(-1))))
    dense = F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r["p"])) == HIGH * WIDE
    f = f.withColumn("_cells", F.when(~dense, cells)).withColumn("_rows", F.when(dense, C("rows.p")).otherwise(filled))
    whole = png("_rows")
    kind = C("image_id") % 10
    content = F.when(kind == SHORT, F.substring(whole, 1, 30)).when(kind == WRONG, F.concat(F.lit(b"JUNK"), F.substring(whole, 5, 20))).otherwise(whole)
    folder = _folder(c)
    write_files(f.select(F.concat(C("image_id").cast("string"), F.lit(".png")).alias("name"), content.alias("content")), folder)
    return folder


def _number(path):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long").alias("image")


add("image_files", lambda c: read_images(c.spark, _png_files(c)).where("not ok or a > 0").select(_number("path"), "ok", "y", "x", "r", "g", "b", "h", "w"),
    lambda q: q.cte(
        f"SELECT image_id AS image, true AS ok, y, x, r, g, b, 32 AS h, 40 AS w FROM {q.pixels()} WHERE image_id % 10 NOT IN ({SHORT}, {WRONG}) "
        f"UNION ALL SELECT DISTINCT image_id, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {q.pixels()} WHERE image_id % 10 IN ({SHORT}, {WRONG})"),
    "image y x r g b h w", bools="ok")
add("image_listing", lambda c: list_images(c.spark, _png_files(c)).select(_number("path"), (C("length") > 30).alias("long_file")),
    lambda q: q.cte(f"SELECT DISTINCT image_id AS image, image_id % 10 <> {SHORT} AND image_id % 10 <> {WRONG} AS long_file FROM {q.pixels()}"), "image", bools="long_file")


def _window(c):
    folder = _folder(c)
    write_zordered(c.ship(), folder, group_bytes=1 << 16)
    return read_window(c.spark, folder, 16, 32, 8, 24)


add("zorder_window", _window, lambda q: q.cte(f"SELECT {q.PX}, v FROM {q.ship()} WHERE y >= 16 AND y < 32 AND x >= 8 AND x < 24"), "image_id ch y x", "v")


def _written_planes(c):
    folder = _folder(c)
    write_planes(c.plane().select("image_id", "ch", "y", "x", "v"), folder, 4)
    return c.spark.read.parquet(folder)


add("planes_written", _written_planes, lambda q: q.cte(f"SELECT {q.PX}, v FROM {q.plane()}"), "image_id ch y x", "v")
