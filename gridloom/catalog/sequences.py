"""Ordered symbol streams: runs, contexts, adaptive costs, entropies."""

from pyspark.sql import functions as F

from gridloom.catalog.base import Sql, add
from gridloom.kernels import byte_counts
from gridloom.operators import scans
from gridloom.operators import sequences as sq

C = F.col
SP = "stream_id pos"

add("symbols", lambda c: c.symbols(), lambda q: q.symbols(), SP + " sym bucket")
add("event_symbols", lambda c: c.event_symbols(), lambda q: q.event_symbols(), SP + " sym bucket")


def _delta_sql(q):
    return q.cte(f"SELECT stream_id, pos, sym, sym - coalesce(lag(sym) OVER (PARTITION BY stream_id ORDER BY pos), 0) AS delta FROM {q.event_symbols()}")


add("delta", lambda c: sq.delta(c.event_symbols(), chunk=16), _delta_sql, SP + " sym delta")
add("undelta", lambda c: sq.undelta(sq.delta(c.event_symbols(), chunk=16), chunk=16),
    lambda q: q.cte(f"SELECT stream_id, pos, greatest(sym, 0) AS restored FROM {q.event_symbols()}"), SP + " restored")


def _runs_sql(q):
    return q.cte(f"SELECT stream_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY stream_id ORDER BY pos), -1) - 1 AS run, sym AS level FROM {q.event_symbols()} WHERE sym <> 0")


add("run_levels", lambda c: sq.run_levels(c.event_symbols(), chunk=16), _runs_sql, SP + " run level")


def _expand(c):
    s = c.event_symbols()
    n = s.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return sq.expand_runs(sq.run_levels(s, chunk=16), n)


add("expand_runs", _expand, lambda q: q.event_symbols(), SP + " sym")

FLAGS = ("SELECT *, pos - coalesce(last_pos, -1) - 1 AS run, CASE WHEN pos > 0 AND pos - coalesce(last_pos, -1) - 1 = 0 THEN 1 ELSE 0 END AS prev_nz, coalesce((abs(last_sym) = 1)::INT, 0) AS prev_pm1 FROM "
         "(SELECT *, last_value(CASE WHEN sym <> 0 THEN pos END IGNORE NULLS) OVER w AS last_pos, last_value(CASE WHEN sym <> 0 THEN sym END IGNORE NULLS) OVER w AS last_sym FROM {} "
         "WINDOW w AS (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")


def _flags(c):
    s = sq.running_last(c.event_symbols(), F.when(C("sym") != 0, F.struct("pos", "sym")), "_l", chunk=16)
    run = C("pos") - F.coalesce(C("_l.pos"), F.lit(-1)) - 1
    return s.select("stream_id", "pos", run.alias("run"), F.when((C("pos") > 0) & (run == 0), 1).otherwise(0).alias("prev_nz"), F.when(F.abs(C("_l.sym")) == 1, 1).otherwise(0).alias("prev_pm1"))


add("run_and_flags", _flags, lambda q: q.cte(FLAGS.format(q.event_symbols())), SP + " run prev_nz prev_pm1")


def _energy_sql(q):
    s = q.symbols()
    e = q.cte(
        f"SELECT stream_id, pos, sym, bucket, 0::BIGINT AS energy FROM {s} WHERE pos = 0 UNION ALL SELECT s.stream_id, s.pos, s.sym, s.bucket, (218 * r.energy + 38 * least(abs(r.sym) * 32, 256)) // 256 "
        f"FROM @self r JOIN {s} s ON s.stream_id = r.stream_id AND s.pos = r.pos + 1", "efold", True)
    return e


add("energy_fold", lambda c: sq.energy_fold(c.symbols()), _energy_sql, SP + " sym energy")


def _ctx_sql(q):
    f = q.cte(FLAGS.format(_energy_sql(q)))
    eb = "CASE WHEN energy < 16 THEN 0 WHEN energy < 64 THEN 1 WHEN energy < 160 THEN 2 ELSE 3 END"
    rc = "CASE WHEN run = 0 THEN 0 WHEN run = 1 THEN 1 WHEN run <= 3 THEN 2 ELSE 3 END"
    return q.cte(f"SELECT *, ({rc}) * 32 + prev_nz * 16 + ({eb}) * 4 + bucket AS zero_ctx, ({eb}) * 8 + prev_pm1 * 4 + bucket AS pm1_ctx FROM {f}")


add("contexts", lambda c: sq.contexts(c.symbols()), _ctx_sql, SP + " sym energy run prev_nz prev_pm1 zero_ctx pm1_ctx")
add("context_table", lambda c: sq.context_table(sq.contexts(c.symbols())),
    lambda q: q.cte(
        f"SELECT *, CASE WHEN p_zero > 0 AND p_zero < 1 THEN -n_zero * log2(p_zero) - (n - n_zero) * log2(1.0 - p_zero) ELSE 0.0 END AS ideal_bits FROM (SELECT zero_ctx, count(*) AS n, count(*) FILTER (sym = 0) AS n_zero, "
        f"count(*) FILTER (abs(sym) = 1) AS n_pm1, count(*) FILTER (sym = 0) / count(*)::DOUBLE AS p_zero FROM {_ctx_sql(q)} GROUP BY zero_ctx)"),
    "zero_ctx n n_zero n_pm1", "p_zero ideal_bits", digits=5)
add("context_rollup", lambda c: sq.context_rollup(sq.contexts(c.symbols())).na.fill(-1, ["bucket", "zero_ctx"]),
    lambda q: q.cte(
        f"SELECT coalesce(bucket, -1) AS bucket, coalesce(zero_ctx, -1) AS zero_ctx, count(*) AS n, count(*) FILTER (sym = 0) AS n_zero, grouping(bucket) * 2 + grouping(zero_ctx) AS level FROM {_ctx_sql(q)} GROUP BY ROLLUP (bucket, zero_ctx)"),
    "bucket zero_ctx n n_zero level")


def _adaptive_sql(q, src, ctx, hit, start, shift):
    s = q.cte(f"SELECT stream_id, {ctx} AS ctx, row_number() OVER (PARTITION BY stream_id, {ctx} ORDER BY pos) AS rn, ({hit}) AS hit FROM {src}")
    f = q.cte(
        f"SELECT stream_id, ctx, 0::BIGINT AS rn, {start}::BIGINT AS p, 0.0::DOUBLE AS bits FROM {s} WHERE rn = 1 UNION ALL SELECT s.stream_id, s.ctx, s.rn, CASE WHEN s.hit THEN p + ((16384 - p) >> {shift}) ELSE p - (p >> {shift}) END, "
        f"bits - log2(least(greatest(CASE WHEN s.hit THEN p ELSE 16384 - p END, 1), 16383) / 16384.0::DOUBLE) FROM @self r JOIN {s} s ON s.stream_id = r.stream_id AND s.ctx = r.ctx AND s.rn = r.rn + 1", "afold", True)
    return q.cte(f"SELECT stream_id, ctx, max(rn) AS n, arg_max(p, rn) AS p_final, arg_max(bits, rn) AS bits FROM {f} GROUP BY ALL")


add("adaptive_cost", lambda c: sq.adaptive_cost(sq.contexts(c.symbols()), "zero_ctx", C("sym") == 0),
    lambda q: _adaptive_sql(q, _ctx_sql(q), "zero_ctx", "sym = 0", 14000, 4), "stream_id ctx n p_final", "bits")


def _stream_cost_sql(q):
    x = _ctx_sql(q)
    nz = q.cte(f"SELECT * FROM {x} WHERE sym <> 0")
    a, b = _adaptive_sql(q, x, "zero_ctx", "sym = 0", 14000, 4), _adaptive_sql(q, nz, "pm1_ctx", "abs(sym) = 1", 12000, 4)
    r = q.cte(f"SELECT stream_id, sum(1.0 + CASE WHEN abs(sym) > 1 THEN 2 * length(bin(abs(sym) - 1)) - 1 ELSE 0 END)::DOUBLE AS bits FROM {nz} GROUP BY ALL")
    return q.cte(f"SELECT stream_id, sum(bits) AS bits FROM (SELECT stream_id, bits FROM {a} UNION ALL SELECT stream_id, bits FROM {b} UNION ALL SELECT stream_id, bits FROM {r}) GROUP BY stream_id")


add("stream_cost", lambda c: sq.stream_cost(sq.contexts(c.symbols())), _stream_cost_sql, "stream_id", "bits")


def _resid_sql(q):
    s = q.cte(f"SELECT *, coalesce(lag(sym) OVER (PARTITION BY stream_id ORDER BY pos), 0) AS p FROM {q.symbols()}")
    s = q.cte(f"SELECT *, CASE WHEN p < 0 THEN 4 ELSE 0 END + CASE WHEN abs(p) >= 4 THEN 3 WHEN abs(p) >= 2 THEN 2 ELSE abs(p) END AS rc FROM {s}")
    return _adaptive_sql(q, s, "rc", "sym = 0", 6554, 5)


add("residual_cost", lambda c: sq.residual_cost(c.symbols()), _resid_sql, "stream_id ctx n p_final", "bits")
add("end_of_block", lambda c: sq.end_of_block(c.symbols()),
    lambda q: q.cte(f"SELECT stream_id, coalesce(max(pos + 1) FILTER (sym <> 0), 0) AS eob, count(*) FILTER (sym <> 0) / count(*)::DOUBLE AS nz_ratio, count(*) AS n FROM {q.symbols()} GROUP BY ALL"),
    "stream_id eob n", "nz_ratio")


def _entropy_sql(q, src, keys, sym):
    h = q.cte(f"SELECT {keys}, {sym}, count(*) AS c FROM {src} GROUP BY ALL")
    return q.cte(f"SELECT {keys}, sum(c) AS n, count(*) AS n_symbols, -sum(c / t * log2(c / t)) AS entropy FROM (SELECT *, (sum(c) OVER (PARTITION BY {keys}))::DOUBLE AS t FROM {h}) GROUP BY {keys}")


add("symbol_entropy", lambda c: sq.entropy(c.symbols(), ["stream_id"], "sym"), lambda q: _entropy_sql(q, q.symbols(), "stream_id", "sym"), "stream_id n n_symbols", "entropy")


def _doc_bytes(c):
    """(doc_id, byte, n): UTF-8 byte counts per document, at most 256 rows each."""
    counts = c.table("documents").select("doc_id", F.posexplode(byte_counts(F.encode("text", "UTF-8"))).alias("byte", "n"))
    return counts.where("n > 0")


add("document_entropy", lambda c: sq.entropy_of_counts(_doc_bytes(c), ["doc_id"], "n"),
    lambda q: _entropy_sql(q, q.cte("SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents"), "doc_id", "byte"), "doc_id n n_symbols", "entropy")


def _byte_streams(c):
    return scans.byte_chunks(c.table("documents"), "source", "doc_id")


def _byte_lists(q):
    return q.cte("SELECT source, regexp_extract_all(string_agg(hex(encode(text)), '' ORDER BY doc_id), '..') AS l FROM documents GROUP BY source", "bytes")


LEVEL = "((('0x' || x)::INT >> 4) - 6)"


def _long_energy_sql(q):
    zero = "{'a': 0, 'e': 0, 't': 0::BIGINT, 'e0': 0, 'e1': 0, 'e2': 0, 'e3': 0}"
    s = q.cte(f"SELECT source, list_transform(l, lambda x: {{'a': abs({LEVEL}), 'e': 0, 't': 0::BIGINT, 'e0': 0, 'e1': 0, 'e2': 0, 'e3': 0}}) AS l FROM {_byte_lists(q)}")
    r = q.cte(
        f"SELECT source, len(l) AS n, list_reduce(l, lambda r, x: {{'a': 0, 'e': (218 * r.e + 38 * least(32 * x.a, 256)) // 256, 't': r.t + r.e, 'e0': r.e0 + (r.e < 16)::INT, 'e1': r.e1 + (r.e >= 16 AND r.e < 64)::INT, "
        f"'e2': r.e2 + (r.e >= 64 AND r.e < 160)::INT, 'e3': r.e3 + (r.e >= 160)::INT}}, {zero}) AS r FROM {s}")
    return q.cte(f"SELECT source, n, r.t AS energy_sum, r.e0 AS e0, r.e1 AS e1, r.e2 AS e2, r.e3 AS e3, r.e AS energy_end FROM {r} WHERE n > 0")


add("long_energy", lambda c: scans.byte_energy(_byte_streams(c), "source"), _long_energy_sql, "n energy_sum e0 e1 e2 e3 energy_end", strs="source")


def _long_residual_sql(q):
    s = q.cte(f"SELECT source, pos, {LEVEL} AS sym FROM (SELECT source, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM {_byte_lists(q)})")
    s = q.cte(f"SELECT *, coalesce(lag(sym) OVER (PARTITION BY source ORDER BY pos), 0) AS p FROM {s}")
    s = q.cte(f"SELECT source, CASE WHEN p < 0 THEN 4 ELSE 0 END + CASE WHEN abs(p) >= 4 THEN 3 WHEN abs(p) >= 2 THEN 2 ELSE abs(p) END AS ctx, pos, sym = 0 AS hit FROM {s}")
    s = q.cte(f"SELECT source, ctx, list({{'h': hit, 'p': 0, 'b': 0.0::DOUBLE}} ORDER BY pos) AS l FROM {s} GROUP BY ALL")
    r = q.cte(
        f"SELECT source, ctx, len(l) AS n, list_reduce(l, lambda r, x: {{'h': true, 'p': CASE WHEN x.h THEN r.p + (16384 - r.p) // 32 ELSE r.p - r.p // 32 END, "
        f"'b': r.b - log2(least(greatest(CASE WHEN x.h THEN r.p ELSE 16384 - r.p END, 1), 16383) / 16384.0::DOUBLE)}}, {{'h': true, 'p': 6554, 'b': 0.0::DOUBLE}}) AS r FROM {s}")
    return q.cte(f"SELECT source, ctx, n, r.p AS p_final, r.b AS bits FROM {r}")


add("long_residual_cost", lambda c: scans.byte_residual_cost(_byte_streams(c), "source"), _long_residual_sql, "ctx n p_final", "bits", "source", digits=4)
add("long_model_cost", lambda c: scans.byte_model_cost(_byte_streams(c), "source"), None, "ctx n p_final", "bits", "source model", digits=4)
