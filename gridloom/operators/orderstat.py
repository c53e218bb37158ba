"""Exact order statistics and ranks that never sort a whole group in one task.

A group (an image, a stream) may hold a large share of all rows, so nothing
here uses an unbounded per-group window.  Values are counted first (equal
values collapse map-side), then located by successive histograms; only the
final, narrow bucket is ordered.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage, shuffled


def order_statistic(df: DataFrame, keys, value, ps: dict, buckets=1024, most=4096) -> DataFrame:
    """``sorted[min(floor(n*p), n-1)]`` per group, one column per entry of ``ps``.

    ``ps`` maps an output name to p.  Group size is returned as ``n``.  The value
    counts are written once; histograms follow each other until no wanted bucket
    holds more than ``most`` distinct values, which are then ordered.
    """
    keys = list(keys)
    counts = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    groups = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in ps.items()])
    picks = groups.withColumn("_w", F.explode(wanted)).select(
        *keys, "n", "_lo", "_hi", F.col("_w.k").alias("_k"),
        F.least(F.floor(F.col("n") * F.col("_w.p")), F.col("n") - 1).alias("_skip"),
    )

    span = F.col("_hi") - F.col("_lo")
    inside = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / F.when(span > 0, span).otherwise(F.lit(1.0)) * buckets),
        F.lit(buckets - 1),
    ).cast("int")
    running = Window.partitionBy(*keys, "_k").orderBy("_b")
    pool = counts.join(picks, keys).withColumn("_b", inside)
    while True:
        hist = pool.groupBy(*keys, "_k", "_b").agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2"),
            F.first("_skip").alias("_skip"), F.first("n").alias("n"), F.count(F.lit(1)).alias("_m"),
        )
        hist = hist.withColumn("_before", F.sum("_c").over(running) - F.col("_c"))
        chosen = cut_lineage(hist.where(
            (F.col("_before") <= F.col("_skip")) & (F.col("_skip") < F.col("_before") + F.col("_c"))
        ).select(
            *keys, "_k", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "n",
            (F.col("_skip") - F.col("_before")).alias("_skip"), "_m",
        ))
        # a bucket's ends are its own smallest and largest values, so the next level always splits it
        pool = counts.join(chosen.drop("_m"), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        if (chosen.agg(F.max("_m")).first()[0] or 0) <= most:
            break
        pool = pool.withColumn("_b", inside)
    in_order = Window.partitionBy(*keys, "_k").orderBy("_v")
    pool = pool.withColumn("_upto", F.sum("_c").over(in_order))
    found = pool.where(F.col("_upto") > F.col("_skip"))
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in ps],
    )


def dense_position(df: DataFrame, keys, order, name="pos", chunk=1 << 16) -> DataFrame:
    """0-based rank by a unique integer ``order`` column within each group.

    Ranks are taken inside ranges of ``chunk`` order values and shifted by the
    sizes of the ranges before, so the work of one large group is spread out.
    """
    keys = list(keys)
    df = df.withColumn("_g", F.floor(F.col(order) / chunk))
    sizes = df.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_g")
    sizes = sizes.select(*keys, "_g", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(order))
    return (
        df.withColumn("_rn", local).join(shuffled(sizes), [*keys, "_g"])
        .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_g", "_rn", "_off")
    )


def min_max(df: DataFrame, keys, value="v") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def normalize(df: DataFrame, keys, value="v", rule="unit", name="norm") -> DataFrame:
    """Min-max normalisation by group.

    ``rule``: "unit" to [0,1], flat groups become 0; "byte" to [0,255] with the
    range floored at 1e-6; "byte_flat" to [0,255], ranges below 1e-6 count as 1.
    """
    span = F.col("hi") - F.col("lo")
    off = F.col(value) - F.col("lo")
    if rule == "unit":
        out = F.when(span > 2.220446049250313e-16, off / F.when(span > 0, span).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    elif rule == "byte":
        out = off * 255.0 / F.greatest(span, F.lit(1e-6))
    else:
        out = off * 255.0 / F.when(span < 1e-6, F.lit(1.0)).otherwise(span)
    return df.join(min_max(df, keys, value), list(keys)).withColumn(name, out).drop("lo", "hi")
