"""Repair of conversation structure by the cheapest edits.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``.
Faulty rows are kept, given another role or deleted and empty turns inserted, at
the least total cost; among equally cheap edits those whose initials come first
in ASCII order are taken.

The search is a Viterbi pass over the rows of a conversation with four states:
nothing yet, system row seen, user's turn taken, pair complete.  The surviving
path of each state is a leaf of a tree of edits that counts how many survivors
and branches hang on each node.  As soon as one branch is left at the root, its
edits are final and leave the tree, so that memory holds only the edits about
which survivors still disagree; runs of deletions take one node.  Survivors are
kept in the order of their whole edit strings: none is a prefix of another (all
end with an edit of the same row), hence the order of longer strings follows
from it and ties need no walk back.
"""

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last one is added for an undeleted truncated row
START, SYSTEM, USER, PAIR = range(4)
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): PAIR, ("u", PAIR): USER}
# WORTH[p][q]: what finishing from state p can cost more than finishing from q, at most (None: not bounded here)
WORTH = {
    START: {SYSTEM: 0, USER: INSERT, PAIR: 0},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, PAIR: INSERT},
    PAIR: {START: DELETE, SYSTEM: 0, USER: INSERT},
}
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@functools.cache
def steps(state, initial, must_go, truncated):
    """Ways over one row from a state: [(edits, state after, cost)]; at most two insertions before a row can pay."""
    out, before, cost = [], "", 0
    for _ in range(3):
        out.append((before + "D", state, cost + DELETE))
        if not must_go:
            extra = cost + (TRUNCATED if truncated else 0)
            if (initial, state) in _KEPT:
                out.append((before + "K", _KEPT[initial, state], extra + KEEP))
            out.append((before + "R", _NEXT[state][1], extra + REROLE))
        before, state, cost = before + "I", _NEXT[state][1], cost + INSERT
    return out


class Node:
    """Edits of one row (or a run of deletions) on the way of some survivors."""

    __slots__ = ("parent", "edits", "times", "row", "branches")

    def __init__(self, parent, edits, row):
        self.parent, self.edits, self.row, self.times, self.branches = parent, edits, row, 1, set()
        if parent is not None:
            parent.branches.add(self)


class Repair:
    """Viterbi pass over one conversation; ``add`` rows, then ``finish``; both yield final edits.

    An edit is (initial, times, role, text); deletions carry neither role nor text.
    """

    def __init__(self):
        self.root = Node(None, "", None)
        self.state = START  # state at the root
        self.alive = {START: (0, 0, self.root)}  # state: (cost, place in the order of edit strings, leaf)
        self.cost = 0

    def add(self, role, text, must_go, truncated):
        best = {}
        for state, (cost, place, leaf) in self.alive.items():
            for edits, after, more in steps(state, role[:1], must_go, truncated):
                new = (cost + more, place, edits, leaf)
                if after not in best or new[:3] < best[after][:3]:
                    best[after] = new
        kept = {s: c for s, c in best.items() if not any(s in WORTH.get(p, ()) and best[p][0] + WORTH[p][s] < c[0] for p in best)}
        order = {s: i for i, s in enumerate(sorted(kept, key=lambda s: kept[s][1:3]))}
        uses = {}
        for c in kept.values():
            uses[id(c[3])] = uses.get(id(c[3]), 0) + 1
        old, row = [leaf for _, _, leaf in self.alive.values()], (role, text)
        self.alive = {}
        for s, (cost, _, edits, leaf) in kept.items():
            if edits == "D" and leaf.edits == "D" and leaf is not self.root and uses[id(leaf)] == 1:
                leaf.times += 1
                self.alive[s] = (cost, order[s], leaf)
            else:
                self.alive[s] = (cost, order[s], Node(leaf, edits, None if edits[-1] == "D" else row))
        ends = {id(leaf) for _, _, leaf in self.alive.values()}
        for leaf in old:
            while leaf is not self.root and not leaf.branches and id(leaf) not in ends:
                leaf.parent.branches.discard(leaf)
                leaf = leaf.parent
        while len(self.root.branches) == 1 and id(self.root) not in ends:
            (node,) = self.root.branches
            if id(node) in ends and node.edits == "D":
                break  # a run of deletions that may grow
            yield from self._final(node.edits, node)
            node.parent, self.root = None, node

    def finish(self):
        ends = {START: "", SYSTEM: "II", USER: "I", PAIR: ""}
        cost, _, last, leaf = min(((c + INSERT * len(ends[s]), place, ends[s], leaf) for s, (c, place, leaf) in self.alive.items()), key=lambda x: x[:3])
        self.cost, way = cost, []
        while leaf is not self.root:
            way.append(leaf)
            leaf = leaf.parent
        for node in reversed(way):
            yield from self._final(node.edits, node)
        yield from self._final(last, None)

    def _final(self, edits, node):
        for e in edits:
            if e == "D":
                yield ("D", node.times, None, None)
            elif e == "K":
                self.state = _KEPT[node.row[0][:1], self.state]
                yield ("K", 1, *node.row)
            else:
                role, self.state = _NEXT[self.state]
                yield (e, 1, role, node.row[1] if e == "R" else "")


def damage(convs: DataFrame) -> DataFrame:
    """Damaged rows: conv_id, turn, role, text, gone.

    Nulls of role and text count as one space, nulls of conv_id and turn too
    where the row's checksum is taken.  Dropped rows stay as ``gone`` markers
    without text, so that a conversation that loses all rows is still known.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(code.isin(0, 1), "").when(code == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    return convs.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(as_text("role")).alias("role"),
        text.alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _seen_before(rows, scratch):
    """Rows with ``later``: whether an earlier turn of the conversation holds the same role and text.

    Only rows that occur twice get into the table of first turns.
    """
    mark = F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    marked = rows.withColumn("_mark", mark).withColumn("_when", when)
    firsts = marked.where("NOT gone").groupBy("_mark").agg(F.min("_when").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return marked.join(scratch.write(firsts), "_mark", "left").withColumn("later", F.coalesce(F.col("_when") > F.col("_first"), F.lit(False))).drop("_mark", "_when", "_first")


def edits(rows: DataFrame) -> DataFrame:
    """Edits that repair conversations, in order, and one closing row for each conversation.

    ``rows`` holds conv_id, turn, role, text and perhaps ``gone`` (rows that only
    name their conversation).  Result: conv_id, edit (K, R, I, D; empty in the
    closing row), times (above 1 for a run of deletions), role, text, and in the
    closing row the counts gaps, blank, duplicate, truncated, illegal and the
    cost.  The rows of a conversation stand together and in order within a
    partition.  Rows are taken by turn, nulls first, then by role and text; other
    columns are ignored.

    A conversation passes through one task as a stream, because a digest of its
    repaired text has to be taken in order; what the task holds is the stretch
    about which survivors disagree.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone"))
    said = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    known = (
        _seen_before(rows, scratch)
        .withColumn("blank", said == "")
        .withColumn("cut", ~F.substring(said, -1, 1).isin(".", "!", "?"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
        .select("conv_id", "turn", "role", "text", "gone", "later", "blank", "cut")
    )
    id_type = rows.schema["conv_id"].dataType
    fields = "edit string, times long, role string, text string, " + ", ".join(f"{c} long" for c in STATS)
    schema = StructType([StructField("conv_id", id_type), *StructType.fromDDL(fields).fields])

    def run(batches):
        started, conv, out, names = False, None, None, [f.name for f in schema.fields]
        for b in batches:
            kind = b.schema.field(0).type
            out = out or _Batches(kind, names)
            for cid, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if not started or cid != conv.cid:
                    if started:
                        out.extend(conv.close())
                    started, conv = True, _Stream(cid)
                out.extend(conv.add(*row))
                yield from out.full()
        if started:
            out.extend(conv.close())
            yield from out.rest()

    return known.mapInArrow(run, schema)


class _Batches:
    """Output rows, handed on in batches of some megabytes."""

    def __init__(self, kind, names):
        text, number = pa.string(), pa.int64()
        self.schema = pa.schema(list(zip(names, [kind, text, number, text, text] + [number] * (len(names) - 5))))
        self.rows, self.size = [], 0

    def extend(self, rows):
        for r in rows:
            self.rows.append(r)
            self.size += 64 + len(r[4] or "")

    def full(self):
        if self.size > 4 << 20:
            yield from self.rest()

    def rest(self):
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows, self.size = [], 0


class _Stream:
    """Faults and repair of the conversation that is passing by."""

    def __init__(self, cid):
        self.cid, self.repair, self.last = cid, Repair(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role, text, gone, later, blank, cut):
        if gone:
            return
        if turn is not None and turn != self.high:  # turns come in ascending order
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        duplicate = not blank and (later or (turn, role, text) == self.last)
        truncated = not blank and not duplicate and cut
        self.illegal += self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.last = (turn, role, text)
        for e in self.repair.add(role, text, blank or duplicate, truncated):
            yield (self.cid, *e, *[None] * len(STATS))

    def close(self):
        for e in self.repair.finish():
            yield (self.cid, *e, *[None] * len(STATS))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        yield (self.cid, "", 0, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repair.cost)


def repaired(found: DataFrame) -> DataFrame:
    """Rows of the repaired conversations from ``edits``: conv_id, role, text, edit, in order within a partition."""
    return found.where(F.col("edit").isin("K", "R", "I")).select("conv_id", "role", "text", "edit")


def digest(found: DataFrame) -> DataFrame:
    """One row per conversation from its ``edits``: the counts, cost, audit (initials of the edits) and repaired_sha256."""
    fields = ", ".join(f"{c} long" for c in STATS) + ", audit string, repaired_sha256 string"
    schema = StructType([found.schema["conv_id"], *StructType.fromDDL(fields).fields])
    names = [f.name for f in schema.fields]

    def fold(batches):
        audit, sha, first = [], hashlib.sha256(), True
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for cid, edit, times, role, text, *stats in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if edit:
                    audit.append(edit * times)
                    if edit != "D":
                        sha.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "replace"))
                        first = False
                else:
                    done.append((cid, *stats, "".join(audit), sha.hexdigest()))
                    audit, sha, first = [], hashlib.sha256(), True
            if done:
                types = [kind] + [pa.int64()] * len(STATS) + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    return found.mapInArrow(fold, schema)


def repair(convs: DataFrame) -> DataFrame:
    """Digest of the repair of damaged conversations: one row for every conv_id of ``convs`` (a null one included).

    A conversation without rows after the damage has zeros, an empty audit and
    the digest of empty text.  An empty table gives no rows.
    """
    return digest(edits(damage(convs)))


def repair_sql():
    """The digest in SQL: the four states' cheapest ways, row by row for all conversations at once."""
    states = "(VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'I', 2), (1, 'I', 2), (2, 'I', 3), (3, 'I', 2), (0, 'II', 3), (1, 'II', 3), (2, 'II', 2), (3, 'II', 3)) AS g(s, ins, m)"
    moves = "(VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2), (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)) AS h(m, e, ini, t)"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
lut AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8),
src AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
crc(r, h, p, c) AS (
  SELECT r, h, 0, 4294967295::BIGINT FROM src
  UNION ALL SELECT r, h, p + 1, xor(l[xor(c & 255, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) + 1], c >> 8) FROM crc, lut WHERE 2 * p < len(h)),
code AS (SELECT r, xor(c, 4294967295) % 20 AS x FROM crc WHERE 2 * p = len(h)),
hurt AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
    CASE x WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src JOIN code USING (r) WHERE x <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
faults AS (
  SELECT *, rtrim(text, {space}) AS said,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM numbered),
rows AS (
  SELECT conv_id, turn, role, text, i, pair, said = '' AS blank, said <> '' AND again AS dup,
    said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS cut FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id),
way(conv_id, i, s, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '' FROM counts
  UNION ALL
  SELECT conv_id, i, s, cost, audit FROM (
    SELECT w.conv_id, r.i, h.t AS s, w.audit || g.ins || h.e AS audit,
      w.cost + {INSERT} * len(g.ins) + CASE h.e WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE {KEEP} END + CASE WHEN r.cut AND h.e <> 'D' THEN {TRUNCATED} ELSE 0 END AS cost
    FROM way w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN {states} ON g.s = w.s JOIN {moves} ON h.m = g.m
    WHERE (h.e = 'D' OR NOT (r.blank OR r.dup)) AND (h.e <> 'K' OR h.ini = r.role[1]))
  QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
ends AS (
  SELECT w.conv_id, w.audit || f.ins AS audit, w.cost + {INSERT} * len(f.ins) AS cost
  FROM way w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) AS f(s, ins) ON f.s = w.s),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
chars AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS k, audit, len(replace(audit, 'D', '')) % 2 AS odd FROM best),
marks AS (
  SELECT conv_id, k, audit[k] AS e, odd, count(*) FILTER (audit[k] <> 'I') OVER w AS i, count(*) FILTER (audit[k] <> 'D') OVER w AS o
  FROM chars WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (
  SELECT m.conv_id, m.k, CASE WHEN e = 'K' THEN r.role WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS line
  FROM marks m LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM said GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""
