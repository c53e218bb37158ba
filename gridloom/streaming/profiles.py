"""Keyed adaptive statistics that continue across micro-batches.

Each function takes a streaming (or static, for tests) frame with the key
columns, an ordering column ``pos`` and an integer ``sym``.  A key's rows are
handled in order within a micro-batch; several lanes per busy key spread its
load, each lane keeping its own model.
"""

import math
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from gridloom.constants import ADAPT_SHIFT, ENERGY_ALPHA, ENERGY_SCALE, P_PM1_INIT, P_ZERO_INIT, PROB_SCALE


def with_lane(df: DataFrame, ident: str, lanes: int) -> DataFrame:
    """Spread each key over ``lanes`` sub-streams."""
    return df.withColumn("lane", F.pmod(F.col(ident), F.lit(lanes)).cast("int"))


PROFILE = "user_id long, lane int, n long, energy int, run int, p_zero int, p_pm1 int, bits double"
PROFILE_STATE = "n long, energy int, run int, p_zero int, p_pm1 int, bits double"


def advance(state, symbols):
    """One adaptive model over a run of symbols: counts, energy, run, probabilities, bits."""
    n, energy, run, pz, p1, bits = state
    for s in symbols:
        a = abs(int(s))
        bits -= math.log2(max(1, min(PROB_SCALE - 1, pz if a == 0 else PROB_SCALE - pz)) / PROB_SCALE)
        if a == 0:
            pz += (PROB_SCALE - pz) >> ADAPT_SHIFT
            run += 1
        else:
            pz -= pz >> ADAPT_SHIFT
            p1 = p1 + ((PROB_SCALE - p1) >> ADAPT_SHIFT) if a == 1 else p1 - (p1 >> ADAPT_SHIFT)
            run = 0
        energy = (ENERGY_ALPHA * energy + (ENERGY_SCALE - ENERGY_ALPHA) * min(a * 32, ENERGY_SCALE)) // ENERGY_SCALE
        n += 1
    return n, energy, run, pz, p1, bits


def _profile_update(key, frames: Iterator[pd.DataFrame], state):
    rows = pd.concat(list(frames)).sort_values("pos")  # one key of one micro-batch
    now = state.get if state.exists else (0, 0, 0, P_ZERO_INIT, P_PM1_INIT, 0.0)
    now = advance(now, rows["sym"])
    state.update(now)
    yield pd.DataFrame([(*key, *now)], columns=["user_id", "lane", "n", "energy", "run", "p_zero", "p_pm1", "bits"])


def adaptive_profile(stream: DataFrame) -> DataFrame:
    """Running profile of each (user_id, lane), one row per micro-batch."""
    return stream.select("user_id", "lane", "pos", "sym").groupBy("user_id", "lane").applyInPandasWithState(
        _profile_update, PROFILE, PROFILE_STATE, "append", GroupStateTimeout.NoTimeout
    )


def _delta_update(key, frames: Iterator[pd.DataFrame], state):
    rows = pd.concat(list(frames)).sort_values("pos")
    before = state.get[0] if state.exists else 0
    sym = rows["sym"].to_numpy()
    state.update((int(sym[-1]),))
    delta = sym.copy()
    delta[1:] -= sym[:-1]
    delta[0] -= before
    yield pd.DataFrame({"user_id": key[0], "lane": key[1], "pos": rows["pos"].to_numpy(), "delta": delta})


def keyed_delta(stream: DataFrame) -> DataFrame:
    """Difference to the key's previous symbol, also across micro-batches."""
    return stream.select("user_id", "lane", "pos", "sym").groupBy("user_id", "lane").applyInPandasWithState(
        _delta_update, "user_id long, lane int, pos long, delta long", "last long", "append", GroupStateTimeout.NoTimeout
    )


def _timed(stream, delay):
    """Event time as an instant (plain local timestamps cannot carry a watermark)."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_metrics(stream: DataFrame, keys, size: str, slide=None, delay="1 hour", value="value") -> DataFrame:
    """Count, energy and error to the rounded value per time window; late rows are dropped.

    Works on streams and on static frames.
    """
    v = F.col(value)
    err = v - F.round(v)
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = _timed(stream, delay).groupBy(win.alias("win"), *keys)
    return _measures(g, v, err, keys)


def session_metrics(stream: DataFrame, keys, gap: str, delay="1 hour", value="value") -> DataFrame:
    """The same per session of activity."""
    v = F.col(value)
    g = _timed(stream, delay).groupBy(F.session_window("ts", gap).alias("win"), *keys)
    return _measures(g, v, v - F.round(v), keys)


def _measures(grouped, v, err, keys):
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(v * v).alias("energy"), F.avg(err * err).alias("mse"))
    return out.select(F.col("win.start").alias("start"), F.col("win.end").alias("end"), *keys, "n", "energy", "mse")
