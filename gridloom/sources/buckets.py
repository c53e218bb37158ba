"""Bucketed, sorted tables for joins and groupings that move no rows.

Two tables written with the same keys and the same number of buckets are
co-partitioned: whatever joins or groups them by these keys (or by more columns)
reads bucket against bucket.  The keys should be finer than an image, so that a
huge image spreads over all buckets; a plane's usual keys are (image_id, ch, y),
those of block coefficients (image_id, gy, gx).
"""

import uuid

from pyspark.sql import DataFrame

from gridloom.session import scratch_folder


def write_bucketed(df: DataFrame, keys, buckets: int, sort=(), name=None, path=None) -> DataFrame:
    """Write a bucketed table, one file a bucket, sorted by keys and ``sort``; returns the table.

    The table is external, at ``path`` (default: a new place in the shared
    folder), and known to the session's catalog as ``name``.  The session is told
    that a join may use a partitioning by some of its keys.
    """
    spark, keys = df.sparkSession, list(keys)
    name, path = name or f"gridloom_{uuid.uuid4().hex}", path or f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spread = df.repartition(buckets, *keys)  # the hash that deals rows to buckets
    spread.write.bucketBy(buckets, *keys).sortBy(*keys, *sort).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)
