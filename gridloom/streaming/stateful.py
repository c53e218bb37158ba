"""Adaptive profiles in event-time order, by arbitrary stateful processing.

Rows of a key may come in any order within the watermark's delay.  A list state
holds those the watermark has not passed; a timer then takes them in order of
time into the model, a value state.  So what a key keeps is its model and the
rows of one delay, however large a micro-batch is, and a key that is silent for
``ttl`` keeps nothing.  Runs may start from the models of an earlier one.
"""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.constants import P_PM1_INIT, P_ZERO_INIT
from gridloom.streaming.profiles import PROFILE, advance

MODEL = ["n", "energy", "run", "p_zero", "p_pm1", "bits"]
START = (0, 0, 0, P_ZERO_INIT, P_PM1_INIT, 0.0)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ProfileProcessor(StatefulProcessor):
    """One adaptive model a key; emits its profile whenever the watermark has let rows in."""

    def __init__(self, ttl_ms=None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "n long, energy int, run int, p_zero int, p_pm1 int, bits double", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "ts long, pos long, sym long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:  # as they come, a piece at a time
            if key[0] is None or pd.isna(key[0]):
                continue
            self.waiting.appendList([(int(t), int(p), int(s)) for t, p, s in zip(frame["at"], frame["pos"], frame["sym"])])
            latest = max(frame["at"].max(), latest or 0)
        if latest is not None:
            self.handle.registerTimer(int(latest) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for r in self.waiting.get():
            (due if r[0] < passed else later).append((r[0], r[1], r[2]))
        if not due:
            return
        due.sort()
        now = advance(tuple(self.model.get()) if self.model.exists() else START, (s for _, _, s in due))
        self.model.update(now)
        self.waiting.put(later) if later else self.waiting.clear()
        yield pd.DataFrame([(*key, *now)], columns=["user_id", "lane", *MODEL])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.model.update((int(r.n), int(r.energy), int(r.run), int(r.p_zero), int(r.p_pm1), float(r.bits)))

    def close(self) -> None:
        pass


def ordered_profile(stream: DataFrame, delay="6 hours", ttl_ms=None, initial: DataFrame | None = None) -> DataFrame:
    """Profiles of each (user_id, lane) in order of (ts, pos): one row whenever rows got final.

    ``initial`` gives profiles to start from (the columns of the result).  Needs
    the RocksDB state store, which is set on the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    keyed = timed.select("user_id", "lane", "ts", F.unix_micros("ts").alias("at"), "pos", "sym").groupBy("user_id", "lane")
    return keyed.transformWithStateInPandas(
        ProfileProcessor(ttl_ms), PROFILE, "Append", "EventTime",
        initialState=None if initial is None else initial.groupBy("user_id", "lane"))


def last_profiles(rows: DataFrame) -> DataFrame:
    """The latest profile of each key."""
    best = rows.groupBy("user_id", "lane").agg(F.max(F.struct(*MODEL)).alias("m"))
    return best.select("user_id", "lane", "m.*")
