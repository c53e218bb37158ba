"""Classes of symbols, runs and energies."""

from pyspark.sql import functions as F

from gridloom.functions.numeric import segmented


def run_class(n):
    return segmented(n, (1, 2, 4), (0, 1, 2, 3))


def run_class_long(n):
    """Six classes, for very sparse streams."""
    return segmented(n, (1, 2, 4, 16, 64), (0, 1, 2, 3, 4, 5))


def energy_bucket(e):
    return segmented(e, (16, 64, 160), (0, 1, 2, 3))


def magnitude_bucket(a):
    return run_class(a)


def zero_context(run, prev_nz, energy, bucket):
    """Index 0..127 of the zero-flag context."""
    return (run_class(run) * 32 + prev_nz * 16 + energy_bucket(energy) * 4
            + F.least(bucket, F.lit(3))).cast("int")


def pm1_context(energy, prev_pm1, bucket):
    """Index 0..31 of the magnitude-one context."""
    return (energy_bucket(energy) * 8 + prev_pm1 * 4 + F.least(bucket, F.lit(3))).cast("int")


def residual_context(prev):
    """Index 0..7: sign and magnitude bucket of the previous residual."""
    p = F.coalesce(prev, F.lit(0))
    return (F.when(p < 0, 4).otherwise(0) + magnitude_bucket(F.abs(p))).cast("int")
