"""Recurrences over long streams, by composition of state maps.

A recurrence with few states (an integer energy, an adaptive probability, a run
class) cannot be summed, but what a chunk of symbols does to it can be written
down: a table from the state before the chunk to the state after it.  Tables
compose, and composition is associative.  So chunks make their tables side by
side, ``FAN`` consecutive tables at a time compose up a tree, start states come
down the same tree, and a second pass over the chunks fills in values.  No task
ever holds more than a chunk or ``FAN`` tables.

The machines here are monotone and contracting (a larger state never leads to a
smaller one): states run together within some hundred symbols.  A table is therefore kept as the distinct states reached, each
with the smallest state that leads to it.  A chunk of up to ``RAW`` symbols
stands for itself until it meets others in the tree.

Chunks are rows ``(keys, index, symbols)``: symbols are the machine's alphabet
as bytes, index is any number that puts the chunks of a stream in order.
"""

import functools
import itertools
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.constants import (
    ADAPT_SHIFT, ENERGY_ALPHA, ENERGY_SCALE, P_PM1_INIT, P_RESIDUAL_INIT, P_ZERO_INIT, PROB_SCALE, RESIDUAL_SHIFT,
)
from gridloom.session import cut_lineage

CHUNK = 1 << 16
FAN_BITS = 6
RAW = 4096
MAP = "struct<raw: binary, cut: array<int>, to: array<int>>"


@dataclass(frozen=True)
class Machine:
    """States 0 .. states - 1; ``step(state, symbol)`` serves numbers and numpy arrays."""

    states: int
    start: int
    step: Callable

    def fold(self, state, symbols):
        return functools.reduce(self.step, symbols, state)

    def before(self, state, symbols):
        """State before each symbol, and the last one."""
        return list(itertools.accumulate(symbols, self.step, initial=state))


def energy_machine():
    """Smoothed energy; a symbol is a magnitude, held to 8."""
    weight = ENERGY_SCALE - ENERGY_ALPHA
    sample = [min(32 * a, ENERGY_SCALE) * weight for a in range(9)]
    return Machine(ENERGY_SCALE + 1, 0, lambda e, a: (e * ENERGY_ALPHA + sample[a]) >> 8)


def probability_machine(start=P_ZERO_INIT, shift=ADAPT_SHIFT):
    """Adaptive probability of a flag; a symbol is 1 for a hit."""
    return Machine(PROB_SCALE + 1, start, lambda p, hit: p + ((PROB_SCALE - p) >> shift) if hit else p - (p >> shift))


def memory_machine(states, start=0):
    """The last symbol."""
    return Machine(states, start, lambda s, x: s * 0 + x)


class _Table:
    """Composition of maps from the identity on, as distinct reached states."""

    def __init__(self, machine):
        self.machine = machine
        self.cut = np.arange(machine.states)
        self.to = self.cut

    def _distinct(self, to):
        keep = np.append(True, to[1:] != to[:-1])
        self.cut, self.to = self.cut[keep], to[keep]

    def symbols(self, raw):
        at = 0
        while at < len(raw) and len(self.to) > 8:
            to = self.to
            for x in raw[at : at + 16]:
                to = self.machine.step(to, x)
            self._distinct(to)
            at += 16
        while at < len(raw):  # few states: plain folds, joined when they meet
            self._distinct(np.array([self.machine.fold(int(v), raw[at : at + RAW]) for v in self.to]))
            at += RAW
        return self

    def table(self, cut, to):
        self._distinct(to[np.searchsorted(cut, self.to, "right") - 1])
        return self

    def row(self):
        return None, self.cut.astype(np.int32), self.to.astype(np.int32)


def _apply(machine, state, raw, cut, to):
    return machine.fold(state, raw) if raw is not None else int(to[np.searchsorted(cut, state, "right") - 1])


def chunk_map(machine):
    """Column function: a chunk's symbols to its map."""

    @F.pandas_udf(MAP)
    def make(symbols: pd.Series) -> pd.DataFrame:
        rows = [(s, None, None) if len(s) <= RAW else _Table(machine).symbols(s).row() for s in symbols]
        return pd.DataFrame(rows, columns=["raw", "cut", "to"])

    return make


def _composed(machine):
    @F.pandas_udf(MAP)
    def compose(raws: pd.Series, cuts: pd.Series, tos: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, cut, to in zip(raws, cuts, tos):
            if all(r is not None for r in raw) and sum(map(len, raw)) <= RAW:
                rows.append((b"".join(raw), None, None))
            else:
                t = _Table(machine)
                for r, c, v in zip(raw, cut, to):
                    t.symbols(r) if r is not None else t.table(c, v)
                rows.append(t.row())
        return pd.DataFrame(rows, columns=["raw", "cut", "to"])

    return compose


def _entered(machine):
    @F.pandas_udf("array<int>")
    def enter(start: pd.Series, raws: pd.Series, cuts: pd.Series, tos: pd.Series) -> pd.Series:
        out = []
        for s, *maps in zip(start, raws, cuts, tos):
            states = [int(s)]
            for m in zip(*maps):
                states.append(_apply(machine, states[-1], *m))
            out.append(states[:-1])
        return pd.Series(out)

    return enter


def _matched(keys, *more):
    """Join condition of columns with their underscored namesakes; a null key is a value of its own."""
    return functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], *more)


def start_states(chunks: DataFrame, keys, machine, index="index", symbols="symbols", fan_bits=FAN_BITS) -> DataFrame:
    """State in which each chunk is entered: (keys, index, start).

    ``chunks`` is read several times and should be a written table.  A stream of
    one chunk needs no map.  Indices must be non-negative; equal ones within a
    stream are not allowed.
    """
    keys = list(keys)
    groups = []
    level = chunks.select(*keys, F.col(index).alias("index"), chunk_map(machine)(symbols).alias("map"))
    most = chunks.agg(F.max(index)).first()[0] or 0
    while most > 0:
        inside = F.array_sort(F.collect_list(F.struct("index", "map")))
        g = cut_lineage(
            level.groupBy(*keys, F.shiftright("index", fan_bits).alias("_up")).agg(inside.alias("m"))
            .select(*keys, "_up", "m.index", F.col("m.map.raw").alias("raw"), F.col("m.map.cut").alias("cut"), F.col("m.map.to").alias("to"))
        )
        groups.append(g)
        level = g.select(*keys, F.col("_up").alias("index"), _composed(machine)("raw", "cut", "to").alias("map"))
        most >>= fan_bits
    starts = (groups[-1].select(*keys, F.col("_up").alias("index")) if groups else chunks.select(*keys, F.col(index).alias("index"))).withColumn("start", F.lit(machine.start))
    for g in reversed(groups):
        up = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("index").alias("_at"), "start")
        entered = g.join(up, _matched(keys, F.col("_up") == F.col("_at"))).withColumn("s", _entered(machine)("start", "raw", "cut", "to"))
        starts = cut_lineage(entered.select(*keys, F.explode(F.arrays_zip("index", "s")).alias("z")).select(*keys, "z.index", F.col("z.s").alias("start")))
    return starts


def entered(chunks: DataFrame, keys, machine, name="start", index="index", symbols="symbols", fan_bits=FAN_BITS) -> DataFrame:
    """Chunks with the state in which each is entered."""
    found = start_states(chunks, keys, machine, index, symbols, fan_bits)
    renamed = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("index").alias("_index"), F.col("start").alias(name))
    return chunks.join(renamed, _matched(keys, F.col(index) == F.col("_index"))).drop("_index", *[f"_{k}" for k in keys])


def states_before(machine):
    """Column function (symbols, start): the state before each symbol of a chunk."""

    @F.pandas_udf("array<int>")
    def fill(symbols: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([machine.before(int(s), x)[:-1] for x, s in zip(symbols, start)])

    return fill


def _code_length(machine):
    """Column function (hits, start): number of flags, last probability and ideal bits of a chunk."""

    @F.pandas_udf("n long, last int, bits double")
    def cost(hits: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = []
        for h, s in zip(hits, start):
            p = machine.before(int(s), h)
            before, hit = np.array(p[:-1]), np.frombuffer(h, np.uint8)
            seen = np.clip(np.where(hit == 1, before, PROB_SCALE - before), 1, PROB_SCALE - 1)
            rows.append((len(h), p[-1], float(-np.log2(seen / PROB_SCALE).sum())))
        return pd.DataFrame(rows, columns=["n", "last", "bits"])

    return cost


def adaptive_bits(chunks: DataFrame, keys, start=P_ZERO_INIT, shift=ADAPT_SHIFT, fan_bits=FAN_BITS) -> DataFrame:
    """Adaptive code length of flag streams given as chunks (keys, index, symbols): keys, n, p_final, bits."""
    machine = probability_machine(start, shift)
    c = entered(chunks, keys, machine, fan_bits=fan_bits).withColumn("c", _code_length(machine)("symbols", "start"))
    return c.groupBy(*keys).agg(
        F.sum("c.n").alias("n"), F.max_by("c.last", "index").alias("p_final"), F.sum("c.bits").alias("bits"))


# ---- streams of rows ---------------------------------------------------

@F.pandas_udf(T.BinaryType())
def _magnitudes(values: pd.Series) -> pd.Series:
    return pd.Series([np.minimum(np.abs(v), 8).astype(np.uint8).tobytes() for v in values])


@F.pandas_udf(T.BinaryType())
def _as_bytes(values: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, dtype=np.uint8).tobytes() for v in values])


def row_chunks(df: DataFrame, keys, columns, chunk_bits=16, pos="pos") -> DataFrame:
    """Rows of each stream by position, in chunks: keys, index, rows (an array of pos and columns in order)."""
    inside = F.array_sort(F.collect_list(F.struct(pos, *columns)))
    return df.groupBy(*keys, F.shiftright(pos, chunk_bits).alias("index")).agg(inside.alias("rows"))


def energy_before(df: DataFrame, keys, columns, chunk_bits=16) -> DataFrame:
    """Rows (keys, pos, columns with ``sym``) with ``energy``, the smoothed energy before each symbol."""
    chunks = cut_lineage(row_chunks(df, keys, columns, chunk_bits).withColumn("symbols", _magnitudes("rows.sym")))
    filled = entered(chunks, keys, energy_machine()).withColumn("e", states_before(energy_machine())("symbols", "start"))
    rows = filled.select(*keys, F.explode(F.arrays_zip("rows", "e")).alias("z"))
    return rows.select(*keys, *[F.col(f"z.rows.{c}").alias(c) for c in ("pos", *columns)], F.col("z.e").alias("energy"))


def adaptive_rows(df: DataFrame, keys, start=P_ZERO_INIT, shift=ADAPT_SHIFT, chunk_bits=16) -> DataFrame:
    """Adaptive code length of the flags ``hit`` (0 or 1) of each stream of rows (keys, pos, hit): keys, n, p_final, bits."""
    chunks = row_chunks(df, keys, ["hit"], chunk_bits).select(*keys, "index", _as_bytes("rows.hit").alias("symbols"))
    return adaptive_bits(cut_lineage(chunks), keys, start, shift)


# ---- streams of text ---------------------------------------------------

def byte_chunks(docs: DataFrame, key, order, text="text", chunk=CHUNK) -> DataFrame:
    """The bytes of all texts of a key as one stream, as chunks: key, order, index, bytes.

    Texts follow each other by ``order`` (nulls first; equal ones by a hash of
    the text), their bytes as UTF-8; null and empty texts add nothing.  A long
    text makes several chunks.  One range sort, then each row is numbered by its
    place in its partition and the sizes of the partitions before.
    """
    raw = docs.select(key, F.col(order).alias("_order"), F.encode(text, "UTF-8").alias("_b"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_row"))
    cut = F.explode(F.sequence(F.lit(0), F.octet_length("_b") - 1, F.lit(chunk)))
    pieces = raw.where(F.octet_length("_b") > 0).withColumn("_at", cut).withColumn("bytes", F.substring(F.col("_b"), F.col("_at") + 1, F.lit(chunk)))
    by = [key, "_order", "_h", "_row", "_at"]
    sorted_ = pieces.drop("_b").repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut_lineage(sorted_.select(key, F.col("_order").alias(order), "bytes", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    index = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(first, "_part").select(key, order, index.alias("index"), "bytes")


def _level(byte):
    """Signed symbol of a byte: its upper half, counted from that of the letters a to o."""
    return (byte >> 4) - 6


def byte_alphabet(kind):
    """Column function: bytes of text to a machine's alphabet (magnitude, residual class or flag class of each byte's symbol)."""
    level = [_level(b) for b in range(256)]
    table = bytes({
        "energy": min(abs(x), 8),
        "residual": (4 if x < 0 else 0) + (3 if abs(x) >= 4 else 2 if abs(x) >= 2 else abs(x)),
        "flag": min(abs(x), 2),
    }[kind] for x in level)

    @F.pandas_udf("binary")
    def translate(b: pd.Series) -> pd.Series:
        return pd.Series([x.translate(table) for x in b])

    return translate


def _hits_by_context(contexts, zero):
    """[(context, flags of its symbols in order)] of a chunk."""
    order = np.argsort(contexts, kind="stable")
    found, first = np.unique(contexts[order], return_index=True)
    return [(int(c), h.tobytes()) for c, h in zip(found, np.split(zero[order].astype(np.uint8), first[1:]))]


def byte_energy(chunks: DataFrame, key, fan_bits=FAN_BITS) -> DataFrame:
    """Energies over byte streams: key, n, energy_sum, symbols met in each of the four energy classes, energy after the end."""
    machine = energy_machine()
    marked = cut_lineage(chunks.select(key, "index", byte_alphabet("energy")("bytes").alias("symbols")))

    @F.pandas_udf("n long, total long, e0 long, e1 long, e2 long, e3 long, last int")
    def measure(symbols: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = []
        for x, s in zip(symbols, start):
            e = machine.before(int(s), x)
            seen = np.array(e[:-1])
            rows.append((len(x), int(seen.sum()), *np.bincount(np.searchsorted((16, 64, 160), seen, "right"), minlength=4).tolist(), e[-1]))
        return pd.DataFrame(rows, columns=["n", "total", "e0", "e1", "e2", "e3", "last"])

    c = entered(marked, [key], machine, fan_bits=fan_bits).withColumn("c", measure("symbols", "start"))
    return c.groupBy(key).agg(
        F.sum("c.n").alias("n"), F.sum("c.total").alias("energy_sum"), *[F.sum(f"c.e{i}").alias(f"e{i}") for i in range(4)],
        F.max_by("c.last", "index").alias("energy_end"))


def byte_residual_cost(chunks: DataFrame, key, fan_bits=FAN_BITS) -> DataFrame:
    """Adaptive zero-flag cost of byte streams by the class of the previous symbol: key, ctx, n, p_final, bits."""
    memory = memory_machine(8)
    marked = cut_lineage(chunks.select(key, "index", byte_alphabet("residual")("bytes").alias("symbols")))

    @F.pandas_udf("array<struct<ctx: int, hits: binary>>")
    def split(symbols: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for x, s in zip(symbols, start):
            own = np.frombuffer(x, np.uint8)
            out.append([{"ctx": c, "hits": h} for c, h in _hits_by_context(np.append(np.uint8(s), own[:-1]), own == 0)])
        return pd.Series(out)

    flags = entered(marked, [key], memory, fan_bits=fan_bits).select(key, "index", F.explode(split("symbols", "start")).alias("z"))
    flags = cut_lineage(flags.select(key, F.col("z.ctx").alias("ctx"), "index", F.col("z.hits").alias("symbols")))
    return adaptive_bits(flags, [key, "ctx"], P_RESIDUAL_INIT, RESIDUAL_SHIFT, fan_bits)


def _after_flag(s, x):
    run, one = (0, 0) if s == 0 else divmod(s - 1, 2)
    return 1 + 2 * min(run + 1, 4) + one if x == 0 else 1 + (x == 1)


_FLAG_ROWS = [[_after_flag(s, x) for x in range(3)] for s in range(11)]
_FLAG = np.array(_FLAG_ROWS)


def flag_machine():
    """Zero run (up to 4) and whether the last non-zero symbol was a one: 1 + 2 * run + one; 0 before the first symbol."""
    return Machine(11, 0, lambda s, x: _FLAG_ROWS[s][x] if isinstance(s, int) else _FLAG[s, x])


def byte_model_cost(chunks: DataFrame, key, bucket=0, fan_bits=FAN_BITS) -> DataFrame:
    """Cost of byte streams under the full context model: key, model (zero or one), ctx, n, p_final, bits.

    The zero flag's context is zero run, previous flag, energy class and bucket;
    that of the magnitude-one flag of non-zero symbols is energy class, whether
    the last non-zero symbol was a one, and bucket.  States run on over a whole stream.
    """
    energy, flags = energy_machine(), flag_machine()
    marked = cut_lineage(chunks.select(key, "index", "bytes", byte_alphabet("energy")("bytes").alias("a"), byte_alphabet("flag")("bytes").alias("f")))
    both = entered(marked, [key], energy, "_e", symbols="a", fan_bits=fan_bits)
    both = entered(both, [key], flags, "_f", symbols="f", fan_bits=fan_bits)

    @F.pandas_udf("array<struct<model: string, ctx: int, hits: binary>>")
    def split(a: pd.Series, f: pd.Series, e0: pd.Series, f0: pd.Series) -> pd.Series:
        out = []
        for mags, cls, e, s in zip(a, f, e0, f0):
            level = np.searchsorted((16, 64, 160), np.array(energy.before(int(e), mags)[:-1]), "right")
            state = np.array(flags.before(int(s), cls)[:-1])
            kind = np.frombuffer(cls, np.uint8)
            run, one = np.maximum(state - 1, 0) // 2, np.maximum(state - 1, 0) % 2
            ran = np.array([0, 1, 2, 2, 3])[run]
            zero_ctx = ran * 32 + ((run == 0) & (state > 0)) * 16 + level * 4 + bucket
            live = kind > 0
            rows = [("zero", c, h) for c, h in _hits_by_context(zero_ctx, kind == 0)]
            if live.any():
                rows += [("one", c, h) for c, h in _hits_by_context((level * 8 + one * 4 + bucket)[live], (kind == 1)[live])]
            out.append([{"model": m, "ctx": c, "hits": h} for m, c, h in rows])
        return pd.Series(out)

    z = both.select(key, "index", F.explode(split("a", "f", "_e", "_f")).alias("z"))
    z = cut_lineage(z.select(key, F.col("z.model").alias("model"), F.col("z.ctx").alias("ctx"), "index", F.col("z.hits").alias("symbols")))
    zero = adaptive_bits(z.where("model = 'zero'"), [key, "model", "ctx"], fan_bits=fan_bits)
    return zero.unionByName(adaptive_bits(z.where("model = 'one'"), [key, "model", "ctx"], P_PM1_INIT, fan_bits=fan_bits))
