"""Token archives compressed by Re-Pair grammars.

Documents are sorted by id over range partitions (shards) and encoded; every
block of about ``BLOCK_TOKENS`` ids inside a shard gets a grammar of its own:
frequent adjacent pairs are replaced by nonterminals, again and again.  A block
is one row of a Parquet table:

``shard, block``  place in the order;
``doc_ids, counts``  its documents and their numbers of ids (with the end id);
``base``  number of the first nonterminal;
``symbols``  little-endian unsigned 16 or 32 bit symbols (``width`` bytes each);
``rules``  unsigned 32 bit pairs, rule k stands for symbol base + k;
``lengths``  unsigned 32 bit expansion lengths of the rules.

The lengths let a reader find any range of ids and expand only the symbols that
cover it.  A document longer than a block makes a longer block.
"""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, remembered
from gridloom.llm.encoding import TokenBytes

BLOCK_TOKENS = 1 << 20
SHARD_BYTES = 24 << 20
END = bytes(4)  # id 0
SLOT_BITS = 19  # of the table that counts pairs: small enough for a core's cache
SCHEMA = "shard int, block int, doc_ids array<long>, counts array<long>, base long, width int, symbols binary, rules binary, lengths binary"


def repair(ids, base, least=8, gain=0.02, rounds=16):
    """Grammar of a sequence: (symbols, rules, expansion lengths).

    A round counts all adjacent pairs, gives those that stand at least ``least``
    times a rank by count, and replaces each occurrence that outranks its
    neighbours; pairs left with fewer than two occurrences get no rule.  It ends
    when a round shortens the sequence by less than ``gain``.  A rule takes
    twelve bytes and an occurrence saves two, hence ``least``.
    """
    seq = np.array(ids, dtype=np.int64)
    rules, lengths = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64)
    for _ in range(rounds):
        if len(seq) < 2 * least:
            break
        span = base + len(rules)
        code = seq[:-1] * span + seq[1:]
        # pairs are counted in a hash table; of two that meet in a slot the later one waits for the next round's hash
        odd = np.uint64(0x9E3779B97F4A7C15 + 2 * (len(rules) << 32))
        slot = (code.view(np.uint64) * odd >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        holder = np.empty(1 << SLOT_BITS, dtype=np.int64)
        holder[slot[::-1]] = code[::-1]
        own = holder[slot] == code
        count = np.bincount(slot[own], minlength=1 << SLOT_BITS)
        held = np.flatnonzero(count >= least)
        if not len(held):
            break
        pairs, count = holder[held], count[held]
        number_of = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        number_of[held] = np.arange(len(held), dtype=np.int32)
        at = number_of[slot]
        where = np.flatnonzero((at >= 0) & own).astype(np.int32)
        at = at[where]
        rank_of = np.empty(len(pairs), dtype=np.int32)
        rank_of[np.lexsort((pairs, -count))] = np.arange(len(pairs), dtype=np.int32)
        mine = rank_of[at]
        beside = where[1:] == where[:-1] + 1
        # in a run of one repeated id its pair overlaps itself: every second place counts
        here = np.arange(len(where), dtype=np.int32)
        head = np.where(np.concatenate([[False], beside & (mine[1:] == mine[:-1])]), 0, here).astype(np.int32)
        chosen = (here - np.maximum.accumulate(head) & 1) == 0
        chosen[1:] &= ~beside | (mine[1:] <= mine[:-1])
        chosen[:-1] &= ~beside | (mine[:-1] <= mine[1:])
        uses = np.bincount(at[chosen], minlength=len(pairs))
        chosen &= uses[at] >= 2
        if np.count_nonzero(chosen) < gain * len(seq):
            break
        used = np.flatnonzero(uses >= 2)
        number = np.zeros(len(pairs), dtype=np.int64)
        number[used] = span + np.arange(len(used))
        new = np.column_stack([pairs[used] // span, pairs[used] % span])
        places = where[chosen]
        seq[places] = number[at[chosen]]
        keep = np.ones(len(seq), dtype=bool)
        keep[places + 1] = False
        seq = seq[keep]
        whole = np.concatenate([np.ones(base, dtype=np.int64), lengths])
        lengths = np.concatenate([lengths, whole[new].sum(axis=1)])
        rules = np.concatenate([rules, new])
    return seq, rules, lengths


def expand(symbols, rules, base):
    """Ids that symbols stand for: all nonterminals open at once, one level a pass."""
    seq = np.asarray(symbols, dtype=np.int64)
    while True:
        inner = seq >= base
        if not inner.any():
            return seq
        pairs = rules[seq[inner] - base]
        out = np.repeat(seq, 1 + inner)
        left = (np.cumsum(1 + inner) - 2)[inner]
        out[left], out[left + 1] = pairs[:, 0], pairs[:, 1]
        seq = out


def pack_block(ids, base):
    """Binary fields of a block: width, symbols, rules, lengths."""
    symbols, rules, lengths = repair(ids, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return width, symbols.astype(f"<u{width}").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes()


class Block:
    """Reader of a block's binary fields."""

    def __init__(self, base, width, symbols, rules, lengths):
        self.base = base
        self.symbols = np.frombuffer(symbols, dtype=f"<u{width}").astype(np.int64)
        self.rules = np.frombuffer(rules, dtype="<u4").astype(np.int64).reshape(-1, 2)
        size = np.frombuffer(lengths, dtype="<u4").astype(np.int64)
        inner = self.symbols >= base
        spans = np.ones(len(self.symbols), dtype=np.int64)
        spans[inner] = size[self.symbols[inner] - base]
        self.ends = np.cumsum(spans)

    def read(self, start, n):
        """Ids start .. start + n of the block; only symbols that cover them are expanded."""
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, start + n - 1, "right")
        skip = start - (self.ends[a - 1] if a else 0)
        return expand(self.symbols[a : b + 1], self.rules, self.base)[skip : skip + n]


def write_archive(docs: DataFrame, path, tokenizer=None, block_tokens=BLOCK_TOKENS, shard_bytes=SHARD_BYTES):
    """Encode documents in ascending doc_id order into an archive at ``path``.

    Null ids come first, equal ids by text; a null text counts as empty and is
    just the end id.  An empty table gives an empty archive.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # numbers beside nulls would come as floats

    def blocks(batches):
        shard = TaskContext.get().partitionId()
        encoder = remembered("token_bytes", tokenizer, lambda: TokenBytes(tokenizer))
        base = encoder.vocabulary
        number, ids, docs_in, counts, size = 0, [], [], [], 0
        for b in batches:
            for d, text in zip(b.doc_id, b.text):
                own = encoder.encode(text)
                ids += [own, END]
                docs_in.append(None if d is None else int(d))
                counts.append(len(own) // 4 + 1)
                size += len(own) // 4 + 1
                if size >= block_tokens:
                    yield _row(shard, number, docs_in, counts, base, ids)
                    number, ids, docs_in, counts, size = number + 1, [], [], [], 0
        if size:
            yield _row(shard, number, docs_in, counts, base, ids)

    ordered.mapInPandas(blocks, SCHEMA).write.mode("overwrite").parquet(path)


def _row(shard, number, docs, counts, base, ids):
    return pd.DataFrame([(shard, number, docs, counts, base, *pack_block(np.frombuffer(b"".join(ids), dtype="<u4"), base))], columns=["shard", "block", "doc_ids", "counts", "base", "width", "symbols", "rules", "lengths"])


def read_archive(spark, path) -> DataFrame:
    """One row per document of an archive: doc_id, start, ids.  ``start`` counts the ids of all documents before it."""
    return _decoded(spark, path, lambda ids: ids, "array<int>", "ids")


def archive_digest(spark, path) -> DataFrame:
    """One row per document of an archive: doc_id, start, n_tokens, ids_crc32."""
    got = _decoded(spark, path, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "array<long>", "x")
    return got.select("doc_id", "start", F.element_at("x", 1).alias("n_tokens"), F.element_at("x", 2).alias("ids_crc32"))


def _decoded(spark, path, use, kind, name):
    blocks = spark.read.schema(SCHEMA).parquet(path)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("shard", "block", size.alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("block_start"))
    starts = inside.join(first, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))
    starts = Scratch(spark).write(starts)  # of known size, so that a small one is sent to the blocks and not they to it

    def read(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                block, at, out = Block(r.base, r.width, r.symbols, r.rules, r.lengths), 0, []
                ids = block.read(0, int(block.ends[-1]))
                for d, n in zip(r.doc_ids, r.counts):
                    out.append((d, r.start + at, use(ids[at : at + n])))
                    at += int(n)
                yield pd.DataFrame(out, columns=["doc_id", "start", name]).astype({"doc_id": "Int64"})

    return blocks.join(starts, ["shard", "block"]).mapInPandas(read, f"doc_id long, start long, {name} {kind}")


def read_document(blocks: DataFrame, doc_id) -> list:
    """Ids of one document (of the first row with that id), expanding only its own range."""
    r = blocks.where(F.array_contains("doc_ids", doc_id)).orderBy("shard", "block").first()
    if r is None:
        return []
    k = r.doc_ids.index(doc_id)
    return Block(r.base, r.width, r.symbols, r.rules, r.lengths).read(sum(r.counts[:k]), r.counts[k]).tolist()
