import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import resampling
from gridloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, rank string, score int, n_words string"


def brute(docs, target, percent=5, least=20):
    """The contract word by word, in one loop."""
    def feats(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in feats(text)[1]:
            s[b] += 1
    for text in target:
        for b in feats(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for d, text in docs:
        n, f = feats(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def result(spark, docs, target, **how):
    df = spark.createDataFrame([(d, t, "x", 1, None) for d, t in docs], SCHEMA)
    return sorted((tuple(r) for r in resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **how).collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    import random

    rng = random.Random(5)
    words = ["Alpha", "beta", "çedille", "x1", "42", "straße", "Ünder", "the", "of", "naïve"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 60])))) for i in range(220)]
    docs += [(None, None), (None, "the of " * 30), (-7, "beta " * 25), (-7, "beta " * 25), (-7, "Beta! " * 25), ((1 << 62) + 1, ""), ((1 << 62) + 3, "odd id " * 20), (-(1 << 63), "x " * 30), (900, "long " * 120_000)]
    return docs, ["the of the beta", None, "", "naïve straße 42 " * 20]


def test_equals_brute_force(spark, texts):
    docs, target = texts
    assert result(spark, docs, target, percent=100) == brute(docs, target, percent=100)
    assert result(spark, docs, [], percent=37, least_words=1) == brute(docs, [], 37, 1)


def test_empty_tables(spark):
    assert result(spark, [], ["a b"]) == []
    assert result(spark, [(1, None)], []) == [(1, 0, 0, brute([(1, None)], [])[0][3], None)]


def test_radix_sort_in_small_chunks(spark):
    """Many chunks, digits that split a column, negative and huge keys, ties by position; the same under two partitionings."""
    n = 1500
    base = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("pos"),
        resampling.ordered_bits(F.pmod(F.xxhash64("id"), F.lit(50)) - 25, descending=True).alias("a"),
        resampling.ordered_bits(F.xxhash64(F.col("id") % 500)).alias("b"),
    )
    want = base.selectExpr("pos as old", "a", "b").toPandas()
    want["ua"], want["ub"] = want.a.astype("uint64"), want.b.astype("uint64")
    want = want.sort_values(["ua", "ub", "old"])
    for parts in (1, 5):
        scratch = Scratch(spark)
        rows = scratch.write(base.repartition(parts).withColumn("old", F.col("pos")))
        got = resampling.radix_ranks(rows, ["a", "b"], scratch, chunk_bits=6, digit_bits=9).orderBy("rank").toPandas()
        assert got["rank"].tolist() == list(range(1, n + 1))
        assert got.old.tolist() == want.old.tolist()


def test_rows_without_differing_bits_keep_their_positions(spark):
    scratch = Scratch(spark)
    rows = scratch.write(spark.range(100).selectExpr("id * 1000 as pos", "id as old", "5L as a"))
    assert [r.old for r in resampling.radix_ranks(rows, ["a"], scratch, chunk_bits=8).orderBy("rank").collect()] == list(range(100))
