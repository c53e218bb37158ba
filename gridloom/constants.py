"""Numeric constants shared by the operators.

Fixed values: they must equal the published ones for results to agree, so they
are kept together here, in natural order.  Everything tunable is a keyword
argument of the operator that uses it; these are only the defaults.
"""

import math

# Golden ratio family.
PHI = 1.618033988749895
PHI_INV = 0.6180339887498949
PHI_INV2 = 0.3819660112501051
PHI_INV3 = 0.2360679774997897
PHI_FREQ = 0.30901699437494742
GOLDEN_ANGLE = 2.3999632297286535

# Tone curve exponent.
PTF_GAMMA = 0.65

# Quantisation surface q = A*d^beta + gamma*r*c, d = sqrt(r^2 + alpha*c^2).
Q_A = 5.0 * math.pi + 2.0
Q_ALPHA = 11.0 / 13.0
Q_BETA = 5.0 * PHI / 9.0
Q_GAMMA = 176.0 * math.pi / 35.0

# Dead zone and step curves.
DEAD_ZONE = 0.22
AC_STEP_FACTOR = 4.9

# Saliency field.
SIGMA_A = 1.5
SIGMA_RATIO = 2.618033988749895
K_STEP = 0.5
RIDGE_THRESHOLD = 0.15
GRADIENT_THRESHOLD = 0.15
FOVEAL_K = 1.5
PIVOT_GAMMA = (1.25, -0.85)

# Primitive matching limits.
MATCH_DISTANCE_MAX = 2.0
MATCH_RADIUS = 4.0
MATCH_POS = 0.5
MATCH_ANGLE = 0.392699
MATCH_AMP = 2.0

# Strength levels and the channel-prediction palette.
STRENGTH_LEVELS = (1, 2, 3, 5, 8, 13, 21, 34)
ALPHA_PALETTE = (-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0)

# Adaptive probability model, 14-bit scale.
PROB_SCALE = 16384
P_ZERO_INIT = 14000
P_PM1_INIT = 12000
P_RESIDUAL_INIT = 6554
ADAPT_SHIFT = 4
RESIDUAL_SHIFT = 5
ENERGY_ALPHA = 218
ENERGY_SCALE = 256

# Band amplitude by contour angle, 5-degree steps from 0 to 90.
BAND_LH = (1.0000, 0.9569, 0.9113, 0.8746, 0.8188, 0.7652, 0.7319, 0.6405, 0.5098, 0.3977,
           0.4291, 0.4101, 0.4402, 0.4433, 0.4304, 0.3564, 0.2945, 0.2078, 0.1828)
BAND_HL = (0.0000, 0.2078, 0.2945, 0.3564, 0.4304, 0.4433, 0.4402, 0.4101, 0.4291, 0.4030,
           0.5098, 0.6405, 0.7319, 0.7652, 0.8188, 0.8746, 0.9113, 0.9569, 0.9750)
BAND_HH = (0.0000, 0.2028, 0.2878, 0.3289, 0.3800, 0.4669, 0.5201, 0.6493, 0.7457, 0.8242,
           0.7457, 0.6493, 0.5201, 0.4669, 0.3800, 0.3289, 0.2878, 0.2028, 0.1259)

# Per scene class (velvet strength, step factor, deblock strength).
SCENE_TUNING = {
    "Flat": (1.5, 0.9, 1.5),
    "Architectural": (1.0, 1.0, 1.0),
    "Perspective": (0.9, 0.95, 0.9),
    "Organic": (0.5, 1.1, 0.5),
    "Mixed": (0.8, 1.0, 0.8),
}

# Per primitive-set class (radius factor, threshold factor, deblock strength).
SHAPE_TUNING = {
    "Architectural": (1.5, 0.8, 1.5),
    "Perspective": (1.3, 0.9, 1.3),
    "Flat": (0.5, 1.2, 0.7),
    "Organic": (0.7, 1.0, 0.8),
    "Mixed": (1.0, 1.0, 1.0),
}

# 31-bit multiplicative generator.
LCG_MUL = 48271
LCG_MOD = 2147483647

# The four directional gradient kernels.
DIRECTIONAL_KERNELS = (
    ((-0.125, -0.25, -0.125), (0, 0, 0), (0.125, 0.25, 0.125)),
    ((-0.125, 0, 0.125), (-0.25, 0, 0.25), (-0.125, 0, 0.125)),
    ((0, -0.125, -0.25), (0.125, 0, -0.125), (0.25, 0.125, 0)),
    ((-0.25, -0.125, 0), (-0.125, 0, 0.125), (0, 0.125, 0.25)),
)
