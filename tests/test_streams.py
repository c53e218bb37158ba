"""Windowed replays return every window, also those open at the end of the input."""
import datetime as dt
import random

import duckdb
import pytest

from gridloom.catalog import base, registered


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out, r = str(tmp_path_factory.mktemp("events")), random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=r.randrange(40 * 3600)), r.randrange(6), r.choice(["view", "click"]), r.random() * 9) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{out}/part")
    file, = (p for p in __import__("pathlib").Path(out, "part").glob("*.parquet"))
    file.rename(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sliding", "stream_sessions"])
def test_open_windows_are_returned(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    cur = con.execute(base.text(registered()[name]))
    names, want = [d[0] for d in cur.description], sorted(cur.fetchall())
    got = sorted(tuple(r) for r in base.run(registered()[name], spark, folder).select(*names).collect())
    assert len(want) == len(got)
    near = lambda a, b: abs(a - b) < 1e-6 if isinstance(a, float) else a == b
    assert all(near(a, b) for g, w in zip(got, want) for a, b in zip(g, w))
    n = sum(r[names.index("n")] for r in got)
    assert max(r[names.index("end")] for r in got) > dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc).timestamp()  # open at the end
    assert n == 400 * (2 if name == "stream_sliding" else 1)
