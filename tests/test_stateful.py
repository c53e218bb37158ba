"""Profiles in event-time order: files out of order, one file a micro-batch, models to start from, bounded state."""
import datetime as dt
import random

from pyspark.sql import functions as F

from gridloom.streaming import stateful as sf
from gridloom.streaming.profiles import advance
from gridloom.streaming.replay import run_files

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user_id long, lane int, ts timestamp, pos long, sym long"


def rows_of(rng, n):
    return [(rng.randrange(4), 0, START + dt.timedelta(seconds=rng.randrange(40 * 3600)), k, rng.randrange(-3, 4)) for k in range(n)]


def folded(rows, first=None):
    out = {}
    for user in {r[0] for r in rows}:
        own = sorted((r[2], r[3], r[4]) for r in rows if r[0] == user)
        out[user] = advance((first or {}).get(user, sf.START), [s for _, _, s in own])
    return out


def test_replay_equals_the_fold_in_time_order(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 900)
    files = [[] for _ in range(3)]
    for r in rows:  # up to two hours out of order across files
        hour = (r[2] - START).total_seconds() / 3600 + rng.random() * 2
        files[min(2, int(hour // 14))].append(r)
    for f in files:
        rng.shuffle(f)
    close = [(None, None, dt.datetime(2200, 1, 1, tzinfo=dt.timezone.utc), None, None)]
    parts = [spark.createDataFrame(f, SCHEMA) for f in [*files, close]]
    first = {1: (7, 33, 2, 9000, 4000, 12.5)}
    models = spark.createDataFrame([(1, 0, *first[1])], sf.PROFILE)
    got = run_files(parts, lambda s: sf.ordered_profile(s, "3 hours", initial=models))
    last = {r.user_id: tuple(r)[2:] for r in sf.last_profiles(got).collect()}
    want = folded(rows, first)
    assert set(last) == set(want)
    for user, w in want.items():
        assert last[user][:5] == w[:5] and abs(last[user][5] - w[5]) < 1e-9
    # rows were let in as the watermark moved, not all at the end: a key was emitted several times
    assert got.groupBy("user_id").count().agg(F.max("count")).first()[0] >= 3
