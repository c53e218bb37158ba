import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def plane_of(spark):
    """Plane from a numpy array (or a list of them, one image each)."""
    def make(*images):
        rows = [(i, 0, y, x, float(v)) for i, a in enumerate(images) for (y, x), v in __import__("numpy").ndenumerate(a)]
        return spark.createDataFrame(rows, "image_id long, ch int, y int, x int, v double")
    return make


@pytest.fixture(scope="session")
def array_of():
    """Numpy array of one image from a plane."""
    import numpy as np

    def make(df, column, image=0):
        pdf = df.where(f"image_id = {image}").select("y", "x", column).toPandas()
        out = np.full((pdf.y.max() + 1, pdf.x.max() + 1), np.nan)
        out[pdf.y, pdf.x] = pdf[column]
        return out
    return make
