import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from gridloom.llm import conversations as C


def brute(rows):
    """Cheapest edits of [(role, text, must_go, truncated)] by trying all of them, up to two insertions at each place."""
    best = None
    for inserts in itertools.product(["", "I", "II"], repeat=len(rows) + 1):
        for es in itertools.product(*(["D"] if g else ["K", "R", "D"] for _, _, g, _ in rows)):
            audit = inserts[0] + "".join(e + i for e, i in zip(es, inserts[1:]))
            odd, out, cost, it, k = sum(e != "D" for e in audit) % 2, "", 0, iter(rows), 0
            for e in audit:
                role, _, _, cut = next(it) if e != "I" else (None, None, None, False)
                if e == "D":
                    cost += 2
                    continue
                out += (role[:1] or "?") if e == "K" else "ua"[(k - odd) % 2] if k >= odd else "?"
                cost += {"K": 0, "R": 1, "I": 5}[e] + (5 if cut else 0)
                k += 1
            if re.fullmatch(r"(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def viterbi(rows):
    r = C.Repair()
    es = [e for row in rows for e in r.add(*row)] + list(r.finish())
    return (r.cost, "".join(e[0] * e[1] for e in es)), es


def test_edits_equal_exhaustive_search():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(40 if n < 4 else 25):
            rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.25) for _ in range(n)]
            rows = [(a, b, g, c and not g) for a, b, g, c in rows]
            assert viterbi(rows)[0] == brute(rows), rows


def plain(rows):
    """The same program without tree or pruning: whole strings in a table."""
    ways = {0: (0, "")}
    for role, _, go, cut in rows:
        new = {}
        for s, (cost, audit) in ways.items():
            for e, t, more in C.steps(s, role[:1], go, cut):
                new.setdefault(t, []).append((cost + more, audit + e))
        ways = {s: min(w) for s, w in new.items()}
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    return min((c + 5 * len(ends[s]), a + ends[s]) for s, (c, a) in ways.items())


def test_long_conversations_equal_plain_tables():
    rng = random.Random(8)
    for roles in (["user", "assistant"], ["system", "user", "assistant", "tool"], ["tool"], ["assistant"]):
        for p in (0.02, 0.3, 0.9):
            rows = [(rng.choice(roles), "t", rng.random() < p, rng.random() < 0.1) for _ in range(400)]
            assert viterbi([(a, b, g, c and not g) for a, b, g, c in rows])[0] == plain([(a, b, g, c and not g) for a, b, g, c in rows])


def nodes(r):
    todo, seen = [r.root], 0
    while todo:
        n = todo.pop()
        seen += 1
        todo += n.branches
    return seen


def test_memory_is_that_of_the_undecided_stretch():
    """Faulty turns, and a run of a hundred thousand deletions after an open question."""
    rng, r, most = random.Random(1), C.Repair(), 0
    for k in range(20_000):
        list(r.add(rng.choice(["user", "assistant"]), "t", rng.random() < 0.05, rng.random() < 0.05))
        most = max(most, nodes(r))
    assert most < 100
    r = C.Repair()
    list(r.add("user", "t", False, False))
    for _ in range(100_000):
        list(r.add("user", "", True, False))
    assert nodes(r) < 20
    late = list(r.add("assistant", "t", False, False))
    assert [e[:2] for e in late + list(r.finish())] == [("K", 1), ("D", 100_000), ("K", 1)]


def contract(rows):
    """Digest of one table {conv: rows}, row by row; rows are (conv, turn, role, text)."""
    blank = lambda t: not re.search(r"[^\x20\x09-\x0D]", t)
    out = []
    for cid in {r[0] for r in rows}:
        got = []
        for _, turn, role, text in (r for r in rows if r[0] == cid):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if cid is None else cid}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            got += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, flat, faults = set(), [], [0, 0, 0]
        for _, role, text in got:
            kind = 0 if blank(text) else 1 if (role, text) in seen else 2 if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            flat.append((role, text, kind in (0, 1), kind == 2))
        (cost, audit), es = viterbi(flat)
        assert (cost, audit) == plain(flat)
        turns = {t for t, _, _ in got if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        lines = "\n".join(f"{r}:{t}" for e, _, r, t in es if e != "D")
        out.append((cid, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def table_rows():
    rng = random.Random(11)
    rows = []
    for cid in [None, *range(60), 1 << 60, -(1 << 60) - 1]:
        for turn in range(rng.choice([1, 1, 4, 9])):
            rows.append((cid, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(["A b.", "What?", "Open end", "", " \t\n", None, "Yes!\r\n", "x " * 30_000 + "."])))
    rows += [(5, None, "user", "A b."), (5, None, None, None), (7, 2, "user", "same."), (7, 2, "user", "same."), (7, 2, "assistant", "same.")]
    rows += [(99, t, "user", "again.") for t in range(300)] + [(98, None, "user", None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, edit string, cost int, later string"


def test_digest_of_damaged_tables(spark):
    rows = table_rows()
    df = spark.createDataFrame([(*r, "x", 3, None) for r in rows], SCHEMA)
    want = contract(rows)
    for parts in (1, 6):
        assert sorted((tuple(r) for r in C.repair(df.repartition(parts)).collect()), key=str) == want
    assert C.repair(df.limit(0)).collect() == []


def test_repaired_rows_are_sound_and_text_ids_serve(spark):
    rows = [(None if r[0] is None else f"c{r[0]}", *r[1:]) for r in table_rows()]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = C.edits(df)
    assert set(found.select("conv_id").distinct().toPandas().conv_id.map(str)) == {str(r[0]) for r in rows}
    out = {}
    for r in C.repaired(found).withColumn("o", F.monotonically_increasing_id()).orderBy("o").collect():
        out.setdefault(r.conv_id, []).append(r.role[:1])
    assert out and all(re.fullmatch(r"s?(ua)+", "".join(v)) for v in out.values())
