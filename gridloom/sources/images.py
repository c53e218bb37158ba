"""Image folders and codec file catalogues."""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.kernels import image_rows
from gridloom.sources.files import file_prefixes

# Fixed value: little-endian header after the 4-byte magic.
HEADER = "<BBHHBf6f"
MAGIC = b"AUR2"
FIELDS = ("version", "quality", "width", "height", "levels", "step", "l_min", "l_max", "c1_min", "c1_max", "c2_min", "c2_max")
HEADER_SCHEMA = T.StructType(
    [T.StructField("ok", T.BooleanType())] + [T.StructField(n, T.IntegerType() if i < 5 else T.DoubleType()) for i, n in enumerate(FIELDS)]
)


def list_images(spark, folder: str, pattern="*.png") -> DataFrame:
    """Paths, sizes and times of image files, sorted; file contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")


def read_images(spark, folder: str) -> DataFrame:
    """Decode PNG/JPEG/BMP files into pixels (image_id, path, ok, y, x, r, g, b, h, w, a).

    image_id is a hash of the path, so it does not depend on file order.  A file
    that cannot be decoded gives one row with ok = false and nulls after it.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    ok = F.col("height") > 0
    rows = img.select(
        F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"), ok.alias("ok"),
        F.when(ok, F.col("height")).alias("h"), F.when(ok, F.col("width")).alias("w"),
        F.posexplode_outer(F.when(ok, image_rows("data", "height", "width", "nChannels"))).alias("y", "row"),
    )
    # Rows are spread before they become pixels, so a large image is not one task.
    rows = rows.repartition("image_id", "y")
    px = rows.select("image_id", "path", "ok", "h", "w", "y", F.posexplode_outer("row").alias("x", "c"))
    part = lambda s: F.shiftright("c", s).bitwiseAND(F.lit(255)).cast("int")
    return px.select("image_id", "path", "ok", "y", "x", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"), "h", "w", (255 - part(24)).alias("a"))


@F.pandas_udf(T.BinaryType())
def png(rows: pd.Series) -> pd.Series:
    """PNG files of images given as lists of rows of packed 24-bit colours; negative ones are clear pixels."""
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    out = []
    for image in rows:
        c = np.stack([np.asarray(r, dtype=np.int64) for r in image])
        rgb = np.stack([c >> 16, c >> 8 & 255, c & 255] + ([np.where(c < 0, 0, 255)] if (c < 0).any() else []), axis=2).astype(np.uint8)
        lines = np.concatenate([np.zeros((len(c), 1), np.uint8), rgb.reshape(len(c), -1)], axis=1)
        head = struct.pack(">IIBBBBB", c.shape[1], c.shape[0], 8, 2 if rgb.shape[2] == 3 else 6, 0, 0, 0)
        out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def codec_header(version: pd.Series, quality: pd.Series, width: pd.Series, height: pd.Series, levels: pd.Series, values: pd.Series) -> pd.Series:
    """39-byte headers: magic, five integers, then step and the three channel ranges (``values``, seven numbers)."""
    heads = zip(version, quality, width, height, levels, values)
    return pd.Series([MAGIC + struct.pack(HEADER, int(v), int(q), int(w), int(h), int(n), *map(float, x)) for v, q, w, h, n, x in heads])


@F.pandas_udf(HEADER_SCHEMA)
def _header(prefix: pd.Series) -> pd.DataFrame:
    rows = []
    for b in prefix:
        good = b is not None and len(b) >= 39 and bytes(b[:4]) == MAGIC
        rows.append((True, *struct.unpack(HEADER, bytes(b[4:39]))) if good else (False, *[None] * len(FIELDS)))
    return pd.DataFrame(rows, columns=["ok", *FIELDS])


def scan_codec_files(spark, folder: str, pattern="*.aur", files_per_task=512) -> DataFrame:
    """Catalogue codec files by their 39-byte header; nothing after it is read (``bytes_read`` says how much was).

    A short file or a wrong magic gives a row with ok = false.  Filters on path
    and length exclude files before they are opened.
    """
    files = file_prefixes(spark, folder, pattern, 4 + struct.calcsize(HEADER), files_per_task)
    df = files.withColumn("_h", _header("prefix")).select("path", "length", "bytes_read", "_h.*")
    px = F.col("width").cast("double") * F.col("height")
    px = F.when(px > 0, px)
    return df.withColumns({"bpp": F.col("length") * 8.0 / px, "ratio": px * 3.0 / F.col("length")})
