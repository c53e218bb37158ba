"""Index maps for positions outside a grid of size ``n``."""

from pyspark.sql import functions as F


def mirror_index(i, n):
    """Periodic mirror without repeating the edge sample."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    j = F.pmod(i, period)
    return F.when(n <= 1, F.lit(0)).when(j >= n, period - j).otherwise(j).cast("int")


def clamp_index(i, n):
    """Nearest valid position."""
    return F.least(F.greatest(i, F.lit(0)), n - 1).cast("int")


def reflect_index(i, n):
    """One reflection at either edge, limited to the grid."""
    return (
        F.when(i < 0, F.least(-i, n - 1))
        .when(i >= n, F.greatest(2 * (n - 1) - i, F.lit(0)))
        .otherwise(i)
        .cast("int")
    )


def border_index(i, n, border):
    return {"clamp": clamp_index, "reflect": reflect_index, "mirror": mirror_index}[border](i, n)
