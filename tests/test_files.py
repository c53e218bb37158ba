"""The file source: prefixes, planned partitions, filters answered from the listing, broken files kept."""
import os
import struct

import numpy as np
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from gridloom.sources import files, read_images, scan_codec_files
from gridloom.sources.images import png


def test_round_trip_and_prefix(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"f{i}.bin", bytes([i]) * i) for i in range(40)]
    files.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(5), folder)
    got = {os.path.basename(r.path): r for r in files.file_prefixes(spark, folder, prefix=7, files_per_task=6).collect()}
    assert {n: (r.length, bytes(r.prefix), r.bytes_read) for n, r in got.items()} == {n: (len(c), c[:7], min(len(c), 7)) for n, c in rows}
    whole = files.file_prefixes(spark, "file:" + folder, "f3*.bin", -1).collect()
    assert {os.path.basename(r.path): bytes(r.prefix) for r in whole} == {n: c for n, c in rows if n.startswith("f3")}
    assert files.file_prefixes(spark, folder, prefix=7, files_per_task=6).rdd.getNumPartitions() == 7
    files.write_files(spark.createDataFrame([("f1.bin", b"new")], "name string, content binary"), folder)
    assert bytes(files.file_prefixes(spark, folder, "f1.bin").first().prefix) == b"new"
    files.write_files(spark.createDataFrame([("only", b"1")], "name string, content binary"), folder, "overwrite")
    assert [os.path.basename(r.path) for r in files.file_prefixes(spark, folder).collect()] == ["only"]


def test_filters_exclude_files_before_they_are_opened(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.aur").write_bytes(b"x" * i * 10)
    reader = files._Reader({"path": str(tmp_path), "filesPerTask": "3"})
    asked = [ds.GreaterThan(("length",), 30), ds.StringEndsWith(("path",), "7.aur"), ds.EqualTo(("prefix",), b"x"), ds.IsNotNull(("length",))]
    assert list(reader.pushFilters(asked)) == [asked[2]]
    assert [os.path.basename(p) for part in reader.partitions() for p, _ in part.value] == ["7.aur"]
    df = files.file_prefixes(spark, str(tmp_path)).where("length > 30 AND path LIKE '%7.aur'")
    assert df.count() == 1
    assert files.file_prefixes(spark, str(tmp_path)).where("length > 1000").collect() == []


def test_only_the_header_is_read(spark, tmp_path):
    """A catalogue of files of eight gigabytes each takes no longer than their headers."""
    for i in range(3):
        with open(tmp_path / f"{i}.aur", "wb") as f:
            f.write(b"AUR2" + struct.pack("<BBHHBf6f", 12, 50, 64, 32, 0, 7.5, *range(6)))
            f.truncate(8 << 30)
    (tmp_path / "short.aur").write_bytes(b"AUR2")
    (tmp_path / "wrong.aur").write_bytes(b"x" * 100)
    (tmp_path / "empty.aur").write_bytes(b"")
    rows = {os.path.basename(r.path): r for r in scan_codec_files(spark, str(tmp_path)).collect()}
    assert all(rows[f"{i}.aur"].ok and rows[f"{i}.aur"].bytes_read == 39 and rows[f"{i}.aur"].length == 8 << 30 for i in range(3))
    assert all(not rows[f"{n}.aur"].ok and rows[f"{n}.aur"].width is None and rows[f"{n}.aur"].bpp is None for n in ("short", "wrong", "empty"))


def test_broken_images_stay_visible(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 1 << 24, (4, 6))
    df = spark.createDataFrame([("a.png", rgb.tolist())], "name string, rows array<array<int>>")
    files.write_files(df.select("name", png("rows").alias("content")), str(tmp_path))
    (tmp_path / "bad.png").write_bytes((tmp_path / "a.png").read_bytes()[:30])
    px = read_images(spark, str(tmp_path)).withColumn("file", F.regexp_extract("path", "[^/]*$", 0)).collect()
    assert [(r.file, r.ok, r.y, r.r, r.h) for r in px if not r.ok] == [("bad.png", False, None, None, None)]
    good = [r for r in px if r.ok]
    assert len(good) == 24 and all((r.r << 16) + (r.g << 8) + r.b == rgb[r.y, r.x] for r in good)


def test_empty_folder(spark, tmp_path):
    assert scan_codec_files(spark, str(tmp_path)).collect() == []
