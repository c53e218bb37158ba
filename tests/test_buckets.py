"""Bucketed tables join and group without an exchange."""
import pytest
from pyspark.sql import functions as F

from gridloom.operators import blocks as bl
from gridloom.operators import quality as ql
from gridloom.sources import write_bucketed


def plan(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pixel_pairs_move_no_rows(spark, no_broadcast):
    df = spark.range(6000).selectExpr("id % 3 as image_id", "0 as ch", "cast(id div 3 % 40 as int) as y", "cast(id div 120 as int) as x", "cast(id * 37 % 255 as double) as v")
    other = df.withColumn("v", F.floor("v"))
    loose, tight = ql.pair(df, other), ql.pair(*[write_bucketed(d, ["image_id", "ch", "y"], 5, ["x"]) for d in (df, other)])
    assert "Exchange" in plan(loose) and "Exchange" not in plan(tight) and "SortMergeJoin" in plan(tight)
    assert sorted(map(tuple, tight.collect())) == sorted(map(tuple, loose.collect()))


def test_channel_prediction_moves_no_rows(spark, no_broadcast):
    luma = spark.range(4000).selectExpr("id % 2 as image_id", "cast(id div 2 % 5 as int) as gy", "cast(id div 10 % 4 as int) as gx", "cast(id div 40 % 8 as int) as u", "cast(id div 320 as int) as w", "cast(id * 31 % 101 - 50 as double) as c")
    luma = luma.dropDuplicates(["image_id", "gy", "gx", "u", "w"])
    chroma = luma.withColumn("c", F.col("c") * 0.5 + F.col("u") % 3)
    loose = bl.channel_prediction(luma, chroma)
    tight = bl.channel_prediction(*[write_bucketed(d, ["image_id", "gy", "gx"], 4, ["u", "w"]) for d in (luma, chroma)])
    assert "Exchange" not in plan(tight)
    key = lambda r: tuple(r)[:5]
    for a, b in zip(sorted(map(tuple, tight.collect()), key=key), sorted(map(tuple, loose.collect()), key=key)):
        assert a[:5] == b[:5] and a[6] == b[6] and all(abs(x - y) < 1e-9 for x, y in zip((a[5], *a[7:]), (b[5], *b[7:])))
