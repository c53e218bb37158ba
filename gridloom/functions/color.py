"""Colour rotation, tone curve and chroma weights."""

from pyspark.sql import functions as F

from gridloom.constants import PHI, PHI_INV, PHI_INV2, PTF_GAMMA
from gridloom.functions.numeric import clamp


def gct_forward(r, g, b):
    """Golden rotation: returns (L, C1, C2); grey pixels have C1 = C2 = 0."""
    lum = (r + PHI * g + PHI_INV * b) * (1.0 / (2.0 * PHI))
    return lum, b - lum, r - lum


def gct_inverse(lum, c1, c2):
    """Back to unrounded (r, g, b)."""
    return lum + c2, lum - PHI_INV2 * c1 - PHI_INV * c2, lum + c1


def rgb_to_ycbcr(r, g, b):
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb = -0.169 * r - 0.331 * g + 0.500 * b + 128.0
    cr = 0.500 * r - 0.419 * g - 0.081 * b + 128.0
    return tuple(clamp(v, 0.0, 255.0) for v in (y, cb, cr))


def ycbcr_to_rgb(y, cb, cr):
    """Clamped, then truncated to int."""
    u, v = cb - 128.0, cr - 128.0
    rgb = (y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u)
    return tuple(clamp(p, 0.0, 255.0).cast("int") for p in rgb)


def tone(v, gamma=PTF_GAMMA):
    """Perceptual curve on 0..255."""
    return 255.0 * F.pow(clamp(v / 255.0, 0.0, 1.0), F.lit(gamma))


def tone_inverse(v, gamma=PTF_GAMMA):
    return tone(v, 1.0 / gamma)


def saturation_raw(c1, c2):
    return F.sqrt(c1 * c1 + c2 * c2)


def phi_chroma_factor(s):
    return PHI_INV2 + (1.0 - PHI_INV2) * (1.0 - s) * (1.0 - s)
