"""Resampling of a corpus towards a target text collection.

Every run of one to three words is hashed into a bucket; a bucket's gain is the
logarithm of its share in the target over its share in the corpus, and a
document's weight is the sum of its features' gains.  A Gumbel draw seeded by
the row key turns weights into a sample without replacement: the highest scores
are drawn.  Scores are ordered by a distributed radix sort, least significant
digit first, whose passes are stable counting sorts.
"""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch

BUCKETS = 10_000
SCALE = 1000  # gains and draws are whole numbers of thousandths
CHUNK_BITS = 18  # a chunk of the sort holds at most this power of two of rows
DIGIT_BITS = 12
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SIGN = -(1 << 63)


def features(text, buckets=BUCKETS):
    """(number of words, bucket of every run of one to three words) of a text.

    A run's checksum continues that of the run one word shorter.
    """
    words = _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []  # bytes.lower changes A-Z only
    after = [b" " + w for w in words]
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, after[1:], one))
    three = list(map(zlib.crc32, after[2:], two))
    n = len(one) + len(two) + len(three)
    return len(words), np.fromiter(itertools.chain(one, two, three), dtype=np.int64, count=n) % buckets


def bucket_counts(docs: DataFrame, buckets=BUCKETS) -> DataFrame:
    """Number of features in each bucket that has any: (bucket, n).  Null texts have none."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.text:
                total += np.bincount(features(text, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    return docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs, target, buckets=BUCKETS):
    """Gain of each bucket, in whole thousandths of a nat, with one feature added to every bucket of both sides."""

    def counts(df):
        out = np.zeros(buckets)
        for r in bucket_counts(df, buckets).collect():  # at most one row a bucket
            out[r.bucket] = r.n
        return out

    s, t = counts(docs), counts(target)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], dtype=np.int64)


def gumbel(key, seed):
    """Gumbel draw of a row key in whole thousandths; a null key counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, seed=42, buckets=BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""
    gains = bucket_gains(docs, target, buckets)

    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def score(batches):
        for b in batches:
            out = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, at = features(text, buckets)
                weight = int(gains[at].sum())
                out.append((d, n, len(at), weight, weight + gumbel(d, seed)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, ", ".join(f"{c} long" for c in names))


def ordered_bits(value, descending=False):
    """A long whose bits, read as an unsigned number, sort as the value does."""
    bits = value.cast("long").bitwiseXOR(F.lit(_SIGN).cast("long"))
    return F.bitwise_not(bits) if descending else bits


def radix_ranks(rows: DataFrame, keys, scratch, chunk_bits=CHUNK_BITS, digit_bits=DIGIT_BITS) -> DataFrame:
    """Rows with ``rank``, their place (from 1) in the order of ``keys``.

    ``keys`` are names of long columns compared as unsigned numbers, most
    significant first; the column ``pos`` holds distinct non-negative numbers,
    whose order ties keep.  Only bits in which rows differ make up digits.  A
    pass moves each row to the number of rows with a smaller digit, plus those
    with its digit in earlier chunks, plus its place among those of its own
    chunk.  No window holds more than a chunk, and counts take a row for each
    digit met in a chunk.
    """
    differ = rows.agg(*[F.bit_or(k).bitwiseXOR(F.bit_and(k)).alias(k) for k in keys]).first()
    bits = [(k, i) for k in reversed(keys) for i in range(64) if (differ[k] or 0) >> i & 1]
    at = rows
    for start in range(0, len(bits) or 1, digit_bits):  # rows without differing bits are numbered in one pass
        places = bits[start : start + digit_bits]
        digit = sum((F.getbit(k, F.lit(i)).cast("int") * (1 << p) for p, (k, i) in enumerate(places)), F.lit(0))
        now = at.withColumn("_digit", digit).withColumn("_chunk", F.shiftright("pos", chunk_bits))
        cells = scratch.write(now.groupBy("_chunk", "_digit").agg(F.count("*").alias("_n")))
        totals = cells.groupBy("_digit").agg(F.sum("_n").alias("_n"))  # at most one row for each value of a digit
        smaller = totals.select("_digit", (F.sum("_n").over(Window.orderBy("_digit")) - F.col("_n")).alias("_smaller"))
        before = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_chunk")) - F.col("_n")
        starts = cells.select("_chunk", "_digit", before.alias("_before")).join(smaller, "_digit")
        inside = F.row_number().over(Window.partitionBy("_chunk", "_digit").orderBy("pos")) - 1
        moved = now.withColumn("_inside", inside).join(starts, ["_chunk", "_digit"])
        place = F.col("_smaller") + F.col("_before") + F.col("_inside")
        after = scratch.write(moved.select(*[c for c in rows.columns if c != "pos"], place.alias("pos")))
        scratch.drop(at, cells)
        at = after
    return at.withColumn("rank", F.col("pos") + 1)


def resample(docs: DataFrame, target: DataFrame, percent=5, least_words=20, seed=42, buckets=BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn).

    Of the N documents with at least ``least_words`` words, floor(percent * N /
    100) with the highest scores are drawn; ties go to the smaller doc_id, a null
    doc_id comes after all others, rows that repeat an id and a score come in
    order of their features.  Null and empty texts have no features and weight 0.
    An empty table gives no rows, an empty target leaves only the corpus counts.
    """
    scratch = Scratch(docs.sparkSession)
    scored = scratch.write(scores(docs, target, seed, buckets).withColumn("pos", F.monotonically_increasing_id()))
    eligible = scored.where(F.col("n_words") >= least_words)
    wanted = percent * eligible.count() // 100
    keys = eligible.select(
        "pos",
        F.col("pos").alias("row"),
        ordered_bits(F.col("score"), descending=True).alias("by_score"),
        F.col("doc_id").isNull().cast("long").alias("by_null"),
        F.coalesce(ordered_bits(F.col("doc_id")), F.lit(0).cast("long")).alias("by_id"),
        ordered_bits(F.col("n_features")).alias("by_features"),
    )
    ranked = radix_ranks(scratch.write(keys), ["by_score", "by_null", "by_id", "by_features"], scratch)
    drawn = ranked.where(F.col("rank") <= wanted).select(F.col("row").alias("pos"), "rank")
    return scored.join(drawn, "pos", "left").select("doc_id", "n_features", "weight", "score", "rank")


def resample_sql(percent=5, least_words=20, seed=42, buckets=BUCKETS):
    """The same in SQL; checksums are folded byte by byte over the distinct features."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{small}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "list_concat(w, list_concat([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]))"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
step AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
d AS (SELECT r, doc_id, len(w) AS n_words, {runs} AS f FROM d0),
b0 AS (SELECT {words} AS w FROM benchmark),
b AS (SELECT unnest({runs}) AS f FROM b0),
df AS (SELECT r, unnest(f) AS f FROM d),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM b)),
crc(f, h, p, c) AS (
  SELECT f, h, 0, 4294967295::BIGINT FROM names
  UNION ALL
  SELECT f, h, p + 1, xor(l[xor(c & 255, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) + 1], c >> 8)
  FROM crc, step WHERE 2 * p < len(h)),
bucket AS (SELECT f, xor(c, 4294967295) % {buckets} AS g FROM crc WHERE 2 * p = len(h)),
s AS (SELECT g, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY g),
t AS (SELECT g, count(*) AS n FROM b JOIN bucket USING (f) GROUP BY g),
gain AS (
  SELECT s.g, floor({SCALE} * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {buckets})::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + {buckets})::DOUBLE)))::BIGINT AS v
  FROM s LEFT JOIN t USING (g)),
w AS (SELECT r, sum(v)::BIGINT AS weight FROM df JOIN bucket USING (f) JOIN gain USING (g) GROUP BY r),
x AS (
  SELECT d.r, doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w ON d.r = w.r),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= {least_words})
SELECT doc_id, n_features, weight, score, rank FROM x LEFT JOIN (SELECT r, rank FROM k WHERE rank <= {percent} * n // 100) q ON x.r = q.r"""
