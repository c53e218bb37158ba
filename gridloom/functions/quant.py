"""Quantisation: quality curves, weighting surfaces, dead zones, rates."""

import math

from pyspark.sql import functions as F

from gridloom.constants import (
    DEAD_ZONE, PIVOT_GAMMA, PROB_SCALE, Q_A, Q_ALPHA, Q_BETA, Q_GAMMA,
)
from gridloom.functions.numeric import clamp, segmented, smoothstep


def luma_zone_factor(dc, factors=(0.7, 0.9, 1.0, 1.2)):
    return segmented(dc, (64.0, 128.0, 192.0), factors)


def csf_factor(row, column, bs, lum, boost=0.5):
    """Contrast-sensitivity weight: dark blocks tolerate coarse high frequencies."""
    side = F.greatest(bs - 1, F.lit(1))
    f2 = (row * row + column * column) / (side * side * 2.0)
    return 1.0 + boost * (1.0 - clamp(lum / 255.0, 0.0, 1.0)) * f2


def _surface(r, c):
    d = F.sqrt(r * r + Q_ALPHA * c * c)
    return F.greatest(Q_A * F.pow(d, F.lit(Q_BETA)) + Q_GAMMA * r * c, F.lit(0.1))


def qmat(row, column, bs):
    """Frequency weight of one coefficient; the DC position is 0."""
    r, c = row / (bs - 1), column / (bs - 1)
    return F.when((row == 0) & (column == 0), F.lit(0.0)).otherwise(_surface(r, c))


def qmat_rotated(row, column, bs, angle):
    """The same surface with its axes turned by ``angle``."""
    r, c = row / (bs - 1), column / (bs - 1)
    rr = r * F.cos(angle) + c * F.sin(angle)
    cc = -r * F.sin(angle) + c * F.cos(angle)
    return F.when((row == 0) & (column == 0), F.lit(0.0)).otherwise(_surface(rr, cc))


def angle_index(angle, steps=8):
    """Nearest of ``steps`` half-turn directions."""
    turn = math.pi / steps
    return (F.floor(F.pmod(angle, F.lit(math.pi)) / turn + 0.5) % steps).cast("int")


def saliency_bucket(t):
    return segmented(t, (0.2, 0.5, 0.8), (0, 1, 2, 3))


def psychovisual_pivot(modulation, q, gammas=PIVOT_GAMMA):
    s = smoothstep(clamp(q / 100.0, 0.0, 1.0))
    gamma = gammas[0] * (1.0 - s) + gammas[1] * s
    return F.pow(clamp(modulation, 0.1, 10.0), gamma)


def dead_zone(q, base=DEAD_ZONE):
    t = clamp((q - 70.0) / 30.0, 0.0, 1.0)
    return base * (1.0 - t) + 0.02 * t


def dead_zone_at(zz, n_ac, dz):
    """Floor the dead zone on the last half and last quarter of the scan."""
    frac = zz / F.greatest(n_ac, F.lit(1))
    return (
        F.when(frac > 0.75, F.greatest(dz, F.lit(0.20)))
        .when(frac > 0.5, F.greatest(dz, F.lit(0.10)))
        .otherwise(dz)
    )


def qmat_power(q, low=0.55, high=0.05, start=60.0, span=40.0):
    s = smoothstep(clamp((q - start) / span, 0.0, 1.0))
    return low * (1.0 - s) + high * s


def spin_weight(q):
    return 0.05 + 0.33 * (1.0 - clamp(q / 100.0, 0.01, 1.0))


def rd_lambda(q, step, scale=5.0):
    s = smoothstep(clamp((q - 50.0) / 40.0, 0.0, 1.0))
    return F.greatest(step * step / 8.33 * (1.5 * (1.0 - s) + 0.3 * s) * scale, F.lit(0.01))


def base_step(q):
    return 39.0 * F.exp(-3.5 * clamp(q / 100.0, 0.01, 1.0)) + 0.9


def detail_step(q, c_norm):
    """Step for a quality and a normalised image complexity."""
    return clamp(base_step(q) * (1.0 - 0.4 * c_norm), 0.1, 48.0)


def dc_step(step):
    return F.greatest(step * 0.1, F.lit(0.2))


def deadzone_quantize(c, step, dz):
    level = F.floor(F.abs(c) / step + 0.5 - dz)
    return F.when(level <= 0, 0).when(c >= 0, level).otherwise(-level).cast("int")


def exp_golomb_bits(n):
    """Length of the order-0 code of a non-negative integer."""
    return 2 * F.length(F.bin(n + 1)) - 1


def bits(p):
    """Ideal code length of probability p."""
    return -F.log2(p)


def rate_bits(q, p_zero, p_pm1):
    """Bits of one symbol given P(zero) and P(magnitude one | non-zero)."""
    a = F.abs(q)
    sign_and_class = bits(1.0 - p_zero) + 1.0
    escape = bits(1.0 - p_pm1) + exp_golomb_bits(F.greatest(a - 2, F.lit(0)))
    return (
        F.when(q == 0, bits(p_zero))
        .when(a == 1, sign_and_class + bits(p_pm1))
        .otherwise(sign_and_class + escape)
    )


def clamp_prob(p):
    """14-bit model probability as a fraction that is never 0 or 1."""
    return clamp(p, 1, PROB_SCALE - 1) / float(PROB_SCALE)
