"""Packing of documents into sequences of bounded length, by hierarchical best fit.

Pieces are dealt to leaves of a bounded size, which pack them by best fit in
order of decreasing length.  Of two bins of a leaf at most one is half empty or
more, or they would be one: that bin, and as many of the bins with the most room
as a parent has children, go up as items; all others are final.  A parent packs
what its children hand on in the same way, up to the root.  A half-empty bin
needs one host, a parent has no more of them than children, and a host with more
room serves whenever one with less does: hence nothing that stays behind could
have lowered the number of sequences, and no task gets more than
``FAN * (FAN + 1)`` bins.
"""

import zlib

import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import Scratch, remembered
from gridloom.llm.encoding import TokenBytes

CAPACITY = 2048
LEAF = 1 << 15  # pieces of a leaf
FAN = 64  # children of a parent
END = bytes(4)


def pieces(docs: DataFrame, capacity=CAPACITY, tokenizer=None, with_ids=False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 (and ids: little-endian unsigned 32 bits).

    A document is its ids and the end id 0.  Only one longer than ``capacity`` is
    cut: all pieces but the first have ``capacity`` ids.  A null text counts as
    empty and gives the end id alone; a null doc_id stays null.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select("doc_id", "text")
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(fields).fields])
    width = 4 * capacity

    def cut(batches):
        encoder = remembered("token_bytes", tokenizer, lambda: TokenBytes(tokenizer))
        for b in batches:
            out = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.encode(text) + END
                first = len(ids) % width or min(width, len(ids))
                edges = [0, *range(first, len(ids) + 1, width)]
                for k, (i, j) in enumerate(zip(edges, edges[1:])):
                    part = ids[i:j]
                    out.append((d, k, i // 4, (j - i) // 4, zlib.crc32(part)) + (part,) * with_ids)
            if out:
                types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(cut, schema)


def best_fit(lengths, capacity):
    """(bin, offset) of each item and the fill of each bin; items come in order of decreasing length.

    Bins wait in one stack for each amount of room; a set bit tells which stacks
    hold any, so the tightest fit is the lowest set bit from the length on.
    """
    room, stacks, fill, places = 0, [[] for _ in range(capacity + 1)], [], []
    for n in lengths:
        fit = room >> n << n
        if fit:
            r = (fit & -fit).bit_length() - 1
            k = stacks[r].pop()
            if not stacks[r]:
                room ^= 1 << r
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        places.append((k, fill[k]))
        fill[k] += n
        if r > n:
            stacks[r - n].append(k)
            room |= 1 << r - n
    return places, fill


def _packed(items, capacity, base, fan):
    """One round: items (item, length, node) with their bin, offset and the bin's fill and whether it goes up."""

    def pack(p):
        p = p.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        places, fill = best_fit(p.length.tolist(), capacity)
        up = [2 * f <= capacity for f in fill]
        for k in sorted((k for k in range(len(fill)) if fill[k] < capacity and not up[k]), key=lambda k: fill[k])[:fan]:
            up[k] = True
        first = (base + int(p.node[0])) << 24
        return pd.DataFrame({
            "item": p["item"], "node": p.node, "bin": [first | k for k, _ in places], "offset": [o for _, o in places],
            "fill": [fill[k] for k, _ in places], "up": [up[k] for k, _ in places],
        })

    return items.groupBy("node").applyInPandas(pack, "item long, node long, bin long, offset long, fill long, up boolean")


def pack(items: DataFrame, capacity=CAPACITY, leaf=LEAF, fan=FAN, scratch=None) -> DataFrame:
    """Places of items (item: distinct long, length: 1 to ``capacity``): item, sequence_id, offset.

    Items that fill a sequence take one of their own.  An empty table gives no rows.
    """
    scratch = scratch or Scratch(items.sparkSession)
    whole = items.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items = items.where(F.col("length") < capacity)
    nodes, base = max(1, -(-open_items.count() // leaf)), 0
    dealt = open_items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(nodes)).alias("node"))
    done, placed = [whole], None
    while True:
        round_ = scratch.write(_packed(dealt, capacity, base, fan))
        if placed is None:
            placed = round_.select("item", "bin", "offset", "up")
        else:  # whatever lay in a bin that went up moves along with it
            moved = round_.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"), F.col("up").alias("on"))
            placed = placed.join(moved, "bin").select("item", F.col("to").alias("bin"), (F.col("offset") + F.col("by")).alias("offset"), F.col("on").alias("up"))
        if nodes == 1:
            return _union(done + [_final(placed)])
        placed = scratch.write(placed)
        done.append(_final(placed.where("NOT up")))
        placed = placed.where("up")
        base, nodes = base + nodes, -(-nodes // fan)
        dealt = round_.where("up AND offset = 0").select(F.col("bin").alias("item"), F.col("fill").alias("length"), F.floor(F.col("node") / fan).alias("node"))


def _final(placed):
    return placed.select("item", F.col("bin").alias("sequence_id"), "offset")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed_pieces(docs: DataFrame, capacity=CAPACITY, tokenizer=None, with_ids=False, leaf=LEAF, fan=FAN) -> DataFrame:
    """Pieces of documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Repeated rows are packed each for itself; an empty table gives no rows.
    Numbers of sequences say nothing but which pieces share one.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.write(pieces(docs, capacity, tokenizer, with_ids).withColumn("item", F.monotonically_increasing_id()))
    places = pack(cut.select("item", "length"), capacity, leaf, fan, scratch)
    return cut.join(places, "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """Sequences from packed pieces that carry their ids: sequence_id, n_tokens, ids (binary, at most four bytes times the capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
