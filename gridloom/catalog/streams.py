"""Streaming replays of the events table."""

from pyspark.sql import functions as F

from gridloom.catalog.base import add
from gridloom.streaming import profiles as pr
from gridloom.streaming import stateful as sf
from gridloom.streaming.replay import run_available, run_closed, run_files, stream_table

C = F.col
LANES = 8


def _keyed(c):
    """Events as integer symbols per user, spread over lanes."""
    e = stream_table(c.spark, c.folder, "events")
    return pr.with_lane(e.withColumns({"pos": C("event_id"), "sym": (F.floor("value") % 7 - 3).cast("long")}), "event_id", LANES)


SYM = "SELECT user_id, event_id % 8 AS lane, event_id AS pos, floor(value)::BIGINT % 7 - 3 AS sym FROM events"


def _profile_sql(q):
    s = q.cte(f"SELECT *, row_number() OVER (PARTITION BY user_id, lane ORDER BY pos) AS rn FROM ({SYM})")
    f = q.cte(
        f"SELECT user_id, lane, 0::BIGINT AS n, 0::BIGINT AS energy, 0::BIGINT AS run, 14000::BIGINT AS p_zero, 12000::BIGINT AS p_pm1, 0.0::DOUBLE AS bits FROM {s} WHERE rn = 1 UNION ALL "
        f"SELECT s.user_id, s.lane, s.rn, (218 * energy + 38 * least(abs(sym) * 32, 256)) // 256, CASE WHEN sym = 0 THEN run + 1 ELSE 0 END, "
        f"CASE WHEN sym = 0 THEN p_zero + ((16384 - p_zero) >> 4) ELSE p_zero - (p_zero >> 4) END, CASE WHEN sym = 0 THEN p_pm1 WHEN abs(sym) = 1 THEN p_pm1 + ((16384 - p_pm1) >> 4) ELSE p_pm1 - (p_pm1 >> 4) END, "
        f"bits - log2(least(greatest(CASE WHEN sym = 0 THEN p_zero ELSE 16384 - p_zero END, 1), 16383) / 16384.0::DOUBLE) FROM @self r JOIN {s} s ON s.user_id = r.user_id AND s.lane = r.lane AND s.rn = r.n + 1", "pfold", True)
    return q.cte(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lane ORDER BY n DESC) AS k FROM {f}) WHERE k = 1")


add("stream_adaptive_profile", lambda c: sf.last_profiles(run_available(pr.adaptive_profile(_keyed(c)))), _profile_sql, "user_id lane n energy run p_zero p_pm1", "bits")
add("stream_keyed_delta", lambda c: run_available(pr.keyed_delta(_keyed(c))),
    lambda q: q.cte(f"SELECT user_id, lane, pos, sym - coalesce(lag(sym) OVER (PARTITION BY user_id, lane ORDER BY pos), 0) AS delta FROM ({SYM})"), "user_id lane pos delta")


def _disordered(c, files=4, hours=5):
    """Events in files that overlap by some hours, so that rows come out of order; a row past all closes the replay."""
    e = c.table("events").withColumns({"pos": C("event_id"), "sym": (F.floor("value") % 7 - 3).cast("long"), "ts": C("ts").cast("timestamp")})
    e = pr.with_lane(e, "event_id", 1).select("user_id", "lane", "ts", "pos", "sym")
    hour = (F.unix_timestamp("ts") / 3600 + F.pmod(F.hash("pos"), F.lit(hours))).cast("long")
    lo, hi = e.agg(F.min(hour), F.max(hour)).first()
    part = F.least(F.floor((hour - lo) * files / (hi - lo + 1)), F.lit(files - 1))
    close = c.spark.range(1).select(*[F.lit("2200-01-01 00:00:00" if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in e.schema])
    return [e.where(part == k) for k in range(files)] + [close]


def _ordered_sql(q):
    s = q.cte("SELECT user_id, 0 AS lane, floor(value)::BIGINT % 7 - 3 AS sym, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
    f = q.cte(f"SELECT user_id, lane, list({{'sym': sym, 'n': 0::BIGINT, 'energy': 0::BIGINT, 'run': 0::BIGINT, 'p_zero': 0::BIGINT, 'p_pm1': 0::BIGINT, 'bits': 0.0::DOUBLE}} ORDER BY rn) AS l FROM {s} GROUP BY ALL")
    r = q.cte(
        f"SELECT user_id, lane, list_reduce(l, lambda r, x: {{'sym': 0::BIGINT, 'n': r.n + 1, 'energy': (218 * r.energy + 38 * least(abs(x.sym) * 32, 256)) // 256, 'run': CASE WHEN x.sym = 0 THEN r.run + 1 ELSE 0 END, "
        f"'p_zero': CASE WHEN x.sym = 0 THEN r.p_zero + (16384 - r.p_zero) // 16 ELSE r.p_zero - r.p_zero // 16 END, 'p_pm1': CASE WHEN x.sym = 0 THEN r.p_pm1 WHEN abs(x.sym) = 1 THEN r.p_pm1 + (16384 - r.p_pm1) // 16 ELSE r.p_pm1 - r.p_pm1 // 16 END, "
        f"'bits': r.bits - log2(least(greatest(CASE WHEN x.sym = 0 THEN r.p_zero ELSE 16384 - r.p_zero END, 1), 16383) / 16384.0::DOUBLE)}}, "
        f"{{'sym': 0::BIGINT, 'n': 0::BIGINT, 'energy': 0::BIGINT, 'run': 0::BIGINT, 'p_zero': 14000::BIGINT, 'p_pm1': 12000::BIGINT, 'bits': 0.0::DOUBLE}}) AS r FROM {f}")
    return q.cte(f"SELECT user_id, lane, r.n AS n, r.energy AS energy, r.run AS run, r.p_zero AS p_zero, r.p_pm1 AS p_pm1, r.bits AS bits FROM {r}")


add("stream_ordered_profile", lambda c: sf.last_profiles(run_files(_disordered(c), sf.ordered_profile)), _ordered_sql, "user_id lane n energy run p_zero p_pm1", "bits")


def _epoch(df):
    return df.withColumns({"start": F.unix_timestamp("start"), "end": F.unix_timestamp("end")})


def _closed(c, windows):
    return _epoch(run_closed(c.spark, c.folder, "events", windows))


MEAS = "count(*) AS n, sum(value * value) AS energy, avg(power(value - round(value), 2)) AS mse"
add("stream_tumbling", lambda c: _closed(c, lambda e: pr.window_metrics(e, ["event_type"], "1 hour")),
    lambda q: q.cte(
        f"SELECT epoch(w) AS start, epoch(w) + 3600 AS \"end\", event_type, n, energy, mse FROM (SELECT date_trunc('hour', ts) AS w, event_type, {MEAS} FROM events GROUP BY ALL)"),
    "start end n", "energy mse", "event_type", digits=9)
add("stream_sliding", lambda c: _closed(c, lambda e: pr.window_metrics(e, ["event_type"], "2 hours", "1 hour")),
    lambda q: q.cte(
        f"SELECT epoch(w) AS start, epoch(w) + 7200 AS \"end\", event_type, n, energy, mse FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS w, event_type, {MEAS} FROM events, unnest(range(2)) AS r(k) GROUP BY ALL)"),
    "start end n", "energy mse", "event_type", digits=9)


def _session_sql(q):
    a = q.cte("SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events")
    b = q.cte(f"SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM {a}")
    return q.cte(f"SELECT epoch_us(min(ts)) // 1000000 AS start, epoch_us(max(ts)) // 1000000 + 7200 AS \"end\", user_id, {MEAS} FROM {b} GROUP BY user_id, s")


add("stream_sessions", lambda c: _closed(c, lambda e: pr.session_metrics(e, ["user_id"], "2 hours")), _session_sql, "start end user_id n", "energy mse", digits=9)
