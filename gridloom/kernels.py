"""Small numpy kernels, each applied to Arrow batches of independent arrays.

Spark decides which arrays meet in a batch; a kernel never sees a whole image
unless the array is one of its rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
COMPLEX = T.StructType([T.StructField("re", DOUBLES), T.StructField("im", DOUBLES)])


def cosine_basis(n):
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi / n * (i + 0.5) * k)


def inverse_basis(n):
    scale = np.full((n, 1), 2.0 / n)
    scale[0] = 1.0 / n
    return (cosine_basis(n) * scale).T


def sine_window(n):
    return np.sin(np.pi * (np.arange(n) + 0.5) / n)


def _by_length(arrays, fn):
    """Apply ``fn`` to stacks of equally long arrays, keeping the input order."""
    lengths = np.fromiter((len(a) for a in arrays), dtype=np.int64, count=len(arrays))
    out = [None] * len(arrays)
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        done = fn(np.stack([arrays[i] for i in where]), int(n))
        for i, row in zip(where, done):
            out[i] = row
    return pd.Series(out)


def _square_transform(basis):
    def apply(stack, n):
        side = int(round(n ** 0.5))
        m = basis(side)
        return (m @ stack.reshape(-1, side, side) @ m.T).reshape(len(stack), n)

    return apply


@F.pandas_udf(DOUBLES)
def dct_blocks(vals: pd.Series) -> pd.Series:
    """Unnormalised 2-D DCT-II of row-major square blocks."""
    return _by_length(vals.to_list(), _square_transform(cosine_basis))


@F.pandas_udf(DOUBLES)
def idct_blocks(vals: pd.Series) -> pd.Series:
    """Inverse of :func:`dct_blocks`."""
    return _by_length(vals.to_list(), _square_transform(inverse_basis))


@F.pandas_udf(COMPLEX)
def fft_rows(vals: pd.Series) -> pd.DataFrame:
    """Half spectrum of each real row."""
    spec = _by_length(vals.to_list(), lambda s, n: np.fft.rfft(s, axis=1))
    return pd.DataFrame({"re": [z.real for z in spec], "im": [z.imag for z in spec]})


@F.pandas_udf(DOUBLES)
def ifft_rows(re: pd.Series, im: pd.Series, n: pd.Series) -> pd.Series:
    """Real rows of length ``n`` from half spectra."""
    return pd.Series([np.fft.irfft(a + 1j * b, n=int(k)) for a, b, k in zip(re, im, n)])


@F.pandas_udf(COMPLEX)
def wiener_columns(re: pd.Series, im: pd.Series, size: pd.Series, noise: pd.Series) -> pd.DataFrame:
    """Column transform, spectral gain and inverse column transform."""
    out_re, out_im = [], []
    for a, b, n, s in zip(re, im, size, noise):
        z = np.fft.fft(a + 1j * b)
        power = (z.real**2 + z.imag**2) / n
        z = np.fft.ifft(z * (np.maximum(power - s * s, 0.0) / (power + 1e-10)))
        out_re.append(z.real)
        out_im.append(z.imag)
    return pd.DataFrame({"re": out_re, "im": out_im})


def _u8_pixels(data, height, width, channels):
    """Row-major RGB bytes from the reader's BGR(A) or grey payload."""
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(img, 3, axis=2) if channels == 1 else img[:, :, 2::-1]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def image_rows(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """Each image as a list of rows of packed 24-bit colours, with 255 minus the opacity above them; null for one that could not be decoded (no height)."""
    out = []
    for d, h, w, c in zip(data, height, width, channels):
        if h <= 0:
            out.append(None)
            continue
        rgb = _u8_pixels(d, h, w, c).astype(np.int32)
        clear = (255 - np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, 3].astype(np.int32)) << 24 if c == 4 else 0
        out.append(list(clear | (rgb[:, :, 0] << 16) | (rgb[:, :, 1] << 8) | rgb[:, :, 2]))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def byte_counts(texts: pd.Series) -> pd.Series:
    """How often each of the 256 byte values stands in a binary value."""
    return pd.Series([np.bincount(np.frombuffer(t or b"", dtype=np.uint8), minlength=256) for t in texts])
