"""The last image of a table may lack tiles; filters then use the cells that are there, as their SQL does."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

NAMES = [
    "block_bitmap_expand", "cas_sharpen", "contrast_adaptive_unsharp", "directional_sharpen", "gaussian_blur", "image_files", "image_listing", "laplacian", "noise_sigma",
    "reference_guided_dering", "resize_rows", "sigma_filter", "structure_aware_sharpen", "wiener_denoise",
]


@pytest.fixture(scope="module", params=[32, 36])
def folder(request, tmp_path_factory):
    d = tmp_path_factory.mktemp("holes")
    n = request.param
    values = np.random.default_rng(n).normal(0, 0.3, (n, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(values), pa.list_(pa.float32()))}), os.path.join(d, "embeddings.parquet"))
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_partial_image_as_in_sql(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    keys = [c for c in cols if c not in ("out", "blur", "lap", "v", "sigma", "bit")]
    cols = keys + [c for c in cols if c not in keys]
    text = lambda row: [str(v) for v in row]  # nulls have no order
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=text)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=text)
    assert len(got) == len(want)
    assert all(a == b or math.isclose(a, b, abs_tol=2e-6) for g, w in zip(got, want) for a, b in zip(g, w))
