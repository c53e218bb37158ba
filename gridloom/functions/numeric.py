"""Rounding, angles and nearest-level search."""

import math

from pyspark.sql import functions as F

from gridloom.constants import ALPHA_PALETTE, STRENGTH_LEVELS


def col(x):
    return F.col(x) if isinstance(x, str) else x


def clamp(v, lo, hi):
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def smoothstep(t):
    return t * t * (3.0 - 2.0 * t)


def round_half_away(v):
    """Nearest integer as double; halves move away from zero."""
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(-F.floor(0.5 - v)).cast("double")


def to_u8(v):
    """Round half away from zero and clamp to 0..255."""
    return F.floor(clamp(v, 0.0, 255.0) + 0.5).cast("int")


def angle_diff(a, b):
    """Signed difference of two angles, wrapped to [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi


def nearest_level(v, levels):
    """Closest entry of a sorted tuple; a tie keeps the lower entry."""
    out = None
    for lo, hi in zip(levels, levels[1:]):
        hit = v <= (lo + hi) / 2
        out = F.when(hit, F.lit(lo)) if out is None else out.when(hit, F.lit(lo))
    return out.otherwise(F.lit(levels[-1]))


def snap_to_levels(force):
    """Signed snap to the strength levels; below one half becomes zero."""
    a = F.abs(force)
    sign = F.when(force >= 0, 1).otherwise(-1)
    return F.when(a < 0.5, F.lit(0)).otherwise(sign * nearest_level(a, STRENGTH_LEVELS))


def quantize_to_palette(alpha):
    return nearest_level(alpha, ALPHA_PALETTE)


def segmented(x, cuts, values):
    """Step function: values[i] below cuts[i], the last value above all cuts."""
    out = None
    for cut, value in zip(cuts, values):
        out = (F if out is None else out).when(x < cut, F.lit(value))
    return out.otherwise(F.lit(values[-1]))
