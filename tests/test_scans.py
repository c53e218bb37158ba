"""State-map scans against plain folds."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scans


@pytest.mark.parametrize("machine, alphabet", [
    (scans.energy_machine(), 9), (scans.probability_machine(), 2), (scans.probability_machine(6554, 5), 2),
    (scans.flag_machine(), 3), (scans.memory_machine(8), 8)])
def test_maps_equal_folds_from_every_state(machine, alphabet):
    rng = random.Random(alphabet)
    for n in (0, 1, 5, 300, 6000):
        for skew in (0, 1, 30):
            raw = bytes(rng.choice([rng.randrange(alphabet)] + [0] * skew) for _ in range(n))
            table = scans._Table(machine).symbols(raw)
            for s in [*range(0, machine.states, max(1, machine.states // 40)), machine.states - 1]:
                assert int(table.to[np.searchsorted(table.cut, s, "right") - 1]) == machine.fold(s, raw)
            if n == 6000:
                assert len(table.to) <= 16


def test_composition_is_associative_and_equals_the_fold_of_the_whole():
    rng, machine = random.Random(1), scans.probability_machine()
    parts = [bytes(rng.choice([0, 0, 1]) for _ in range(rng.choice([3, 90, 500]))) for _ in range(12)]
    maps = [scans._Table(machine).symbols(p).row()[1:] for p in parts]
    left = scans._Table(machine)
    for m in maps:
        left.table(*m)
    right = scans._Table(machine)
    for k in range(0, 12, 4):
        inner = scans._Table(machine)
        for m in maps[k : k + 4]:
            inner.table(*m)
        right.table(*inner.row()[1:])
    for s in range(0, machine.states, 97):
        whole = machine.fold(s, b"".join(parts))
        assert int(left.to[np.searchsorted(left.cut, s, "right") - 1]) == int(right.to[np.searchsorted(right.cut, s, "right") - 1]) == whole


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta ", "of", " the", "Ünder", "\n", "0123 ", "東京", "zzz", "  "]
    rows = [(i % 3 and f"s{i % 3}" or None, i // 2 if i != 50 else None, "".join(rng.choices(words, k=rng.choice([0, 3, 60, 400])))) for i in range(150)]
    return rows + [("s1", 7, None), ("s1", 7, "same"), ("s1", 7, "same"), ("s2", 200, "x y " * 60_000), ("empty", 1, ""), ("empty", 2, None)]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(texts(), "source string, doc_id long, text string")
    return scans.byte_chunks(df, "source", "doc_id", chunk=9000)


@pytest.fixture(scope="module")
def streams(spark, chunks):
    """The bytes of each source, put together from the chunks; their order is checked against the rows."""
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: r["index"]):
        out.setdefault(r.source, []).append((r.doc_id, bytes(r.bytes)))
    for source, parts in out.items():
        ids = [d for d, _ in parts]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
        for d in set(ids):
            want = sorted((t or "").encode() for s, i, t in texts() if s == source and i == d)
            got = b"".join(b for i, b in parts if i == d)
            assert len(got) == sum(map(len, want)) and (len(want) > 3 or any(got == b"".join(p) for p in __import__("itertools").permutations(want)))
    assert set(out) == {None, "s1", "s2"}
    return {s: [(b >> 4) - 6 for _, x in parts for b in x] for s, parts in out.items()}


def adapt(hits, p, shift):
    bits = 0.0
    for h in hits:
        bits -= math.log2(min(max(p if h else 16384 - p, 1), 16383) / 16384)
        p = p + ((16384 - p) >> shift) if h else p - (p >> shift)
    return len(hits), p, bits


def test_byte_energy(chunks, streams):
    for fan_bits in (1, 6):
        got = {r.source: r for r in scans.byte_energy(chunks, "source", fan_bits).collect()}
        assert set(got) == set(streams)
        for s, syms in streams.items():
            e, seen = 0, []
            for x in syms:
                seen.append(e)
                e = (218 * e + 38 * min(32 * abs(x), 256)) // 256
            r = got[s]
            assert (r.n, r.energy_sum, r.energy_end) == (len(syms), sum(seen), e)
            assert [r.e0, r.e1, r.e2, r.e3] == [sum(a <= v < b for v in seen) for a, b in ((0, 16), (16, 64), (64, 160), (160, 300))]


def test_byte_residual_cost(chunks, streams):
    got = {(r.source, r.ctx): (r.n, r.p_final, r.bits) for r in scans.byte_residual_cost(chunks, "source", 1).collect()}
    want = {}
    for s, syms in streams.items():
        for p, x in zip([0] + syms, syms):
            want.setdefault((s, (4 if p < 0 else 0) + (3 if abs(p) >= 4 else 2 if abs(p) >= 2 else abs(p))), []).append(x == 0)
    assert set(got) == set(want)
    for k, hits in want.items():
        n, p, bits = adapt(hits, 6554, 5)
        assert got[k][:2] == (n, p) and got[k][2] == pytest.approx(bits)


def test_byte_model_cost(chunks, streams):
    got = {(r.source, r.model, r.ctx): (r.n, r.p_final, r.bits) for r in scans.byte_model_cost(chunks, "source", bucket=2, fan_bits=2).collect()}
    want = {}
    for s, syms in streams.items():
        e = run = prev_nz = prev_one = 0
        for x in syms:
            level = sum(e >= t for t in (16, 64, 160))
            want.setdefault((s, "zero", min(run, 4) * 0 + (0 if run == 0 else 1 if run == 1 else 2 if run <= 3 else 3) * 32 + prev_nz * 16 + level * 4 + 2), []).append(x == 0)
            if x:
                want.setdefault((s, "one", level * 8 + prev_one * 4 + 2), []).append(abs(x) == 1)
            e = (218 * e + 38 * min(32 * abs(x), 256)) // 256
            run, prev_one, prev_nz = (run + 1, prev_one, 0) if x == 0 else (0, int(abs(x) == 1), 1)
    assert set(got) == set(want)
    for k, hits in want.items():
        n, p, bits = adapt(hits, 14000 if k[1] == "zero" else 12000, 4)
        assert got[k][:2] == (n, p) and got[k][2] == pytest.approx(bits)


def test_no_group_holds_more_than_a_fan_of_maps(spark, chunks):
    """The hot source has some thirty chunks; with fans of two no task meets more than two maps."""
    marked = chunks.select("source", "index", scans.byte_alphabet("energy")("bytes").alias("symbols"))
    sizes = marked.groupBy("source", F.shiftright("index", 1)).count().agg(F.max("count")).first()[0]
    assert sizes <= 2
    assert marked.agg(F.max(F.octet_length("symbols"))).first()[0] <= 9000


def test_empty_table(spark):
    none = scans.byte_chunks(spark.createDataFrame([], "source string, doc_id long, text string"), "source", "doc_id")
    assert scans.byte_energy(none, "source").collect() == []
