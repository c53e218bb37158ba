"""Packing into length buckets with least padding.

The global histogram of lengths is a grouped aggregate.  Dynamic programming
over it chooses the bucket boundaries that minimise padding for a given number
of buckets; every document is then padded to its bucket's boundary, and batches
of at most a token budget are formed inside each bucket.

The histogram that the driver sees has a row of three numbers for each distinct
length, 24 bytes each: a million different lengths are 24 MB.  The program over
it is exact: any length may be a boundary.
"""

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_SPLIT
from gridloom.session import cut_lineage

ROWS_PER_RUN = 50_000  # rows numbered by one task


def word_tokens(text):
    """Length in tokens, one a word and one that ends the document."""
    words = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return F.size(F.array_remove(words, "")).cast("long") + 1


def optimal_boundaries(lengths, counts, buckets):
    """Boundaries (ascending, the last is the longest length) with the least padding, and that padding.

    Lengths ascend.  A last bucket of lengths i..j costs lengths[j] * rows(i..j)
    less its tokens: for each i a line in lengths[j], whose slope falls as i
    grows while lengths[j] grows with j.  So the lower envelope of the lines is
    kept as a queue and every bucket more takes one pass over the lengths.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    n = len(lengths)
    if n == 0:
        return [], 0
    rows = [0, *itertools.accumulate(counts)]
    tokens = [0, *itertools.accumulate(a * b for a, b in zip(lengths, counts))]
    best = [lengths[j] * rows[j + 1] - tokens[j + 1] for j in range(n)]  # one bucket for lengths 0..j
    cuts = []
    for _ in range(min(buckets, n) - 1):
        nxt, cut, lines, front = [], [], [], 0
        for j in range(n):
            # earlier buckets end at i - 1, the last one holds i..j; i = 0 leaves it alone
            new = (-rows[j], (best[j - 1] if j else 0) + tokens[j], j)
            while len(lines) - front >= 2 and _hidden(lines[-2], lines[-1], new):
                lines.pop()
            lines.append(new)
            x = lengths[j]
            while front + 1 < len(lines) and lines[front + 1][0] * x + lines[front + 1][1] < lines[front][0] * x + lines[front][1]:
                front += 1
            nxt.append(lines[front][0] * x + lines[front][1] + x * rows[j + 1] - tokens[j + 1])
            cut.append(lines[front][2])
        best = nxt
        cuts.append(cut)
    ends, j = [], n - 1
    for cut in reversed(cuts):
        ends.append(lengths[j])
        j = cut[j] - 1
        if j < 0:
            break
    if j >= 0:
        ends.append(lengths[j])
    return ends[::-1], best[-1]


def _hidden(a, b, c):
    """Whether line b (slope, intercept) lies nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def histogram(docs: DataFrame, length) -> DataFrame:
    """The global length histogram: len, rows."""
    return docs.select(length.cast("long").alias("len")).groupBy("len").agg(F.count("*").alias("rows"))


def pack(docs: DataFrame, buckets=16, budget=16384, length=None) -> DataFrame:
    """One row per document: doc_id, length, bucket, boundary, batch_id, slot, padding.

    ``length`` is a column of positive lengths (default: words + 1; null and
    empty texts have length 1).  A batch holds max(1, budget // boundary)
    documents, so only a document longer than the budget exceeds it, alone.
    Batches are numbered within their bucket and all but the last are full.  Rows
    with equal ids are packed each; an empty table gives an empty result.
    """
    length = word_tokens(F.col("text")) if length is None else length
    sized = cut_lineage(docs.select("doc_id", length.cast("long").alias("length")))  # texts are read once
    found = histogram(sized, F.col("length")).toArrow().sort_by("len")
    lengths, counts = found.column("len").to_pylist(), found.column("rows").to_pylist()
    ends, _ = optimal_boundaries(lengths, counts, buckets)
    total = sum(counts)
    runs = max(1, -(-total // ROWS_PER_RUN))
    bounds = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array(F.lit(0).cast("long"))
    rows = sized.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("length"))).cast("int"))
    rows = rows.withColumn("boundary", F.try_element_at(bounds, F.col("bucket") + 1))
    # numbers within a bucket: runs of a bounded size are numbered apart, then moved up by the rows of the runs before
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "length"), F.lit(runs)))
    before = rows.groupBy("bucket", "run").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("bucket").orderBy("run")) - F.col("n"),
    ).drop("n")
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "run").orderBy("doc_id", "length")) - 1)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("boundary")))
    numbered = numbered.join(before, ["bucket", "run"]).withColumn("at", F.col("at") + F.col("before"))
    return numbered.select(
        "doc_id", "length", "bucket", "boundary", F.floor(F.col("at") / each).alias("batch_id"),
        F.pmod(F.col("at"), each).alias("slot"), (F.col("boundary") - F.col("length")).alias("padding"),
    )
