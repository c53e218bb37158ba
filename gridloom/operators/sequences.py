"""Ordered symbol streams ``(stream_id, pos, sym, bucket)``, pos dense from 0.

A stream may be very long, so it is handled in chunks of consecutive
positions.  Fixed offsets take a one-row halo from the previous chunk;
running values are computed inside chunks and completed with one carried row
per chunk, which is a prefix scan in two levels.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.constants import (
    ADAPT_SHIFT, P_PM1_INIT, P_RESIDUAL_INIT, P_ZERO_INIT, RESIDUAL_SHIFT,
)
from gridloom.functions.quant import bits
from gridloom.functions.symbols import pm1_context, residual_context, zero_context
from gridloom.operators.scans import adaptive_rows, energy_before
from gridloom.session import shuffled

CHUNK = 1 << 16


def with_previous(df: DataFrame, columns: dict, keys=("stream_id",), pos="pos", chunk=CHUNK) -> DataFrame:
    """Add the value of ``columns[name]`` at the previous position as ``name``."""
    home = F.floor(F.col(pos) / chunk)
    last = (F.col(pos) % chunk) == chunk - 1
    df = df.withColumn("_c", F.explode(F.when(last, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(*keys, "_c").orderBy(pos)
    df = df.withColumns({name: F.lag(col).over(w) for name, col in columns.items()})
    return df.where(F.col("_c") == home).drop("_c")


def running_last(df: DataFrame, value, name, keys=("stream_id",), pos="pos", chunk=CHUNK) -> DataFrame:
    """Last non-null ``value`` strictly before each position."""
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_c", F.floor(F.col(pos) / chunk)).withColumn("_val", value)
    tail = df.groupBy(*keys, "_c").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(pos))).alias("_t"))
    over_chunks = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select(*keys, "_c", F.last("_t", ignorenulls=True).over(over_chunks).alias("_carry"))
    inside = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.last("_val", ignorenulls=True).over(inside))
    return (
        df.join(shuffled(carry), [*keys, "_c"])
        .withColumn(name, F.coalesce("_in", "_carry")).drop("_c", "_val", "_in", "_carry")
    )


def running_sum(df: DataFrame, value, name, keys=("stream_id",), pos="pos", chunk=CHUNK) -> DataFrame:
    """Inclusive prefix sum."""
    df = df.withColumn("_c", F.floor(F.col(pos) / chunk))
    totals = df.groupBy(*keys, "_c").agg(F.sum(value).alias("_t"))
    over_chunks = Window.partitionBy(*keys).orderBy("_c")
    carry = totals.select(*keys, "_c", (F.sum("_t").over(over_chunks) - F.col("_t")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_in", F.sum(value).over(inside)).join(shuffled(carry), [*keys, "_c"])
        .withColumn(name, F.col("_in") + F.col("_carry")).drop("_c", "_in", "_carry")
    )


def delta(df: DataFrame, value="sym", name="delta", keys=("stream_id",), pos="pos", chunk=CHUNK) -> DataFrame:
    """Difference to the previous value; the first is kept as is."""
    df = with_previous(df, {"_p": F.col(value)}, keys, pos, chunk)
    return df.withColumn(name, F.col(value) - F.coalesce(F.col("_p"), F.lit(0))).drop("_p")


def undelta(df: DataFrame, value="delta", name="restored", keys=("stream_id",), pos="pos", chunk=CHUNK) -> DataFrame:
    """Inverse of :func:`delta`; output is floored at 0, the accumulator is not."""
    df = running_sum(df, value, "_acc", keys, pos, chunk)
    return df.withColumn(name, F.greatest(F.col("_acc"), F.lit(0))).drop("_acc")


def run_levels(df: DataFrame, keys=("stream_id",), chunk=CHUNK) -> DataFrame:
    """(run of zeros, level) pairs; trailing zeros are implied by the length."""
    marked = running_last(df, F.when(F.col("sym") != 0, F.col("pos")), "_last", keys, chunk=chunk)
    return marked.where(F.col("sym") != 0).select(
        *keys, "pos", (F.col("pos") - F.coalesce(F.col("_last"), F.lit(-1)) - 1).alias("run"),
        F.col("sym").alias("level"),
    )


def expand_runs(pairs: DataFrame, lengths: DataFrame, keys=("stream_id",)) -> DataFrame:
    """Rebuild streams from pairs; ``lengths`` has one ``n`` per stream."""
    zeros = pairs.select(
        *keys, F.explode(F.sequence(F.col("pos") - F.col("run"), F.col("pos"))).alias("p"), "pos", "level"
    ).select(*keys, F.col("p").alias("pos"), F.when(F.col("p") == F.col("pos"), F.col("level")).otherwise(0).alias("sym"))
    ends = pairs.groupBy(*keys).agg((F.max("pos") + 1).alias("_end"))
    tail = (
        lengths.join(ends, list(keys), "left").withColumn("_end", F.coalesce("_end", F.lit(0)))
        .where(F.col("_end") < F.col("n"))
        .select(*keys, F.explode(F.sequence(F.col("_end"), F.col("n") - 1)).alias("pos"), F.lit(0).alias("sym"))
    )
    return zeros.unionByName(tail)


def end_of_block(df: DataFrame, keys=("stream_id",)) -> DataFrame:
    """Position after the last non-zero symbol, and the non-zero share."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("sym") != 0, F.col("pos") + 1)), F.lit(0)).alias("eob"),
        F.avg(F.when(F.col("sym") != 0, 1.0).otherwise(0.0)).alias("nz_ratio"),
        F.count(F.lit(1)).alias("n"),
    )


def entropy(df: DataFrame, keys, symbol) -> DataFrame:
    """Order-0 entropy in bits per symbol of each group."""
    keys = list(keys)
    return entropy_of_counts(df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("_c")), keys, "_c")


def entropy_of_counts(hist: DataFrame, keys, count) -> DataFrame:
    """Entropy from a histogram: log2(N) - sum(c log2 c) / N, one pass."""
    c = F.col(count)
    return hist.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.count(F.lit(1)).alias("n_symbols"),
        (F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("entropy"),
    )


def energy_fold(df: DataFrame, keys=("stream_id",), chunk_bits=16) -> DataFrame:
    """Smoothed integer energy seen *before* each symbol.

    The recurrence divides integers, so it is no sum: chunks of a stream are
    joined by their state maps (:mod:`gridloom.operators.scans`).
    """
    return energy_before(df, list(keys), ["sym", "bucket"], chunk_bits)


def contexts(df: DataFrame, keys=("stream_id",), chunk=CHUNK) -> DataFrame:
    """Coding context of every symbol: zero run, previous flags, energy, indices."""
    df = energy_fold(df, keys)
    nz = F.col("sym") != 0
    df = running_last(df, F.when(nz, F.struct("pos", "sym")), "_last", keys, chunk=chunk)
    last_pos = F.coalesce(F.col("_last.pos"), F.lit(-1))
    run = F.col("pos") - last_pos - 1
    df = df.withColumns({
        "run": run,
        "prev_nz": F.when((F.col("pos") > 0) & (run == 0), 1).otherwise(0),
        "prev_pm1": F.when(F.abs(F.col("_last.sym")) == 1, 1).otherwise(0),
    }).drop("_last")
    return df.withColumns({
        "zero_ctx": zero_context(F.col("run"), F.col("prev_nz"), F.col("energy"), F.col("bucket")),
        "pm1_ctx": pm1_context(F.col("energy"), F.col("prev_pm1"), F.col("bucket")),
    })


def context_table(ctx: DataFrame, keys=()) -> DataFrame:
    """Counts, probabilities and ideal bits of each zero context."""
    n, z = F.count(F.lit(1)), F.count_if(F.col("sym") == 0)
    one = F.count_if(F.abs(F.col("sym")) == 1)
    t = ctx.groupBy(*keys, "zero_ctx").agg(n.alias("n"), z.alias("n_zero"), one.alias("n_pm1"))
    p = F.col("n_zero") / F.col("n")
    inner = (F.col("n_zero") > 0) & (F.col("n_zero") < F.col("n"))
    cost = F.when(inner, F.col("n_zero") * bits(F.when(inner, p)) + (F.col("n") - F.col("n_zero")) * bits(F.when(inner, 1 - p)))
    return t.withColumns({"p_zero": p, "ideal_bits": F.coalesce(cost, F.lit(0.0))})


def context_rollup(ctx: DataFrame) -> DataFrame:
    """Context counts with subtotals by bucket and overall."""
    return ctx.rollup("bucket", "zero_ctx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sym") == 0).alias("n_zero"),
        F.grouping_id().cast("int").alias("level"),
    )


def adaptive_cost(df: DataFrame, ctx, hit, keys=("stream_id",), start=P_ZERO_INIT, shift=ADAPT_SHIFT, chunk_bits=16) -> DataFrame:
    """Adaptive code length of a binary flag per (stream, context), however long the stream."""
    hit = hit if not isinstance(hit, str) else F.col(hit)
    flags = df.select(*keys, F.col(ctx).alias("ctx"), "pos", hit.cast("int").alias("hit"))
    return adaptive_rows(flags, [*keys, "ctx"], start, shift, chunk_bits)


def stream_cost(ctx: DataFrame, keys=("stream_id",)) -> DataFrame:
    """Total adaptive bits per stream: zero flags, signs, magnitude flags, escapes."""
    from gridloom.functions.quant import exp_golomb_bits

    zero = adaptive_cost(ctx, "zero_ctx", F.col("sym") == 0, keys)
    nz = ctx.where(F.col("sym") != 0)
    one = adaptive_cost(nz, "pm1_ctx", F.abs(F.col("sym")) == 1, keys, P_PM1_INIT)
    a = F.abs(F.col("sym"))
    raw = nz.groupBy(*keys).agg(
        F.sum(1.0 + F.when(a > 1, exp_golomb_bits(F.greatest(a - 2, F.lit(0)))).otherwise(0)).alias("bits")
    )
    parts = [d.select(*keys, "bits") for d in (zero, one, raw)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(F.sum("bits").alias("bits"))


def residual_cost(df: DataFrame, keys=("stream_id",), chunk=CHUNK) -> DataFrame:
    """Adaptive zero-flag cost of residuals, by sign and size of the previous one."""
    df = with_previous(df, {"_p": F.col("sym")}, keys, chunk=chunk)
    df = df.withColumn("res_ctx", residual_context(F.col("_p"))).drop("_p")
    return adaptive_cost(df, "res_ctx", F.col("sym") == 0, keys, P_RESIDUAL_INIT, RESIDUAL_SHIFT)


def top_energy(coeffs: DataFrame, keys, k: int) -> DataFrame:
    """The k largest coefficients of each block with cumulative energy share.

    Blocks are bounded by their size, so the window is short.
    """
    e = F.col("c") * F.col("c")
    order = Window.partitionBy(*keys).orderBy(F.desc("e"), "zz")
    whole = Window.partitionBy(*keys)
    df = coeffs.withColumn("e", e).withColumns({
        "rank": F.row_number().over(order),
        "cum": F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("e").over(whole),
    })
    return df.where(F.col("rank") <= k).withColumn(
        "share", F.when(F.col("total") > 0, F.col("cum") / F.col("total")).otherwise(0.0)
    ).drop("e", "cum", "total")
