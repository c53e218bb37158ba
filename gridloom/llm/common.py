"""Helpers shared by the operators of this subpackage."""

import itertools
import sys
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import _checkpoint_dir_set, write_table

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checksum(c):
    """crc32 of a value written as text."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


def held_out(c, parts, part):
    """Whether a row belongs to the held-out fold; false for a null id."""
    return F.coalesce(checksum(c) % parts == part, F.lit(False))


def training_ids(labels, label, parts, part, bound, per_class=False) -> DataFrame:
    """A bounded, reproducible sample of labelled rows outside the held-out fold: (doc_id, label, order).

    Rows without id or label are left out; a document labelled twice counts as
    its highest label.  At most ``bound`` rows (or rows of each class), those
    with the smallest hash of their id.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out("doc_id", parts, part))
        .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    if not per_class:
        return one.orderBy("order", "doc_id").limit(bound)
    return one.where("label = 1").orderBy("order", "doc_id").limit(bound).unionByName(one.where("label = 0").orderBy("order", "doc_id").limit(bound))


def remembered(name, key, make):
    """An object that a Python worker keeps for the tasks to come: the last one of its name, if made for the same key.

    Code travels to workers by value, so its own globals begin anew with each task.
    """
    kept = sys.modules.setdefault("gridloom_worker_memory", types.ModuleType("gridloom_worker_memory")).__dict__
    if name not in kept or kept[name][0] != key:
        kept[name] = key, make()
    return kept[name][1]


def fit_logistic(x, y, ridge=1.0, rounds=30):
    """Weights of a logistic regression (last one: intercept) by Newton steps on standardised columns."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / sd
    return np.append(slope, w[-1] - slope @ mean)


def logistic(x, w):
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, float) @ w[:-1] + w[-1], -30, 30)))


class Scratch:
    """Tables written into the shared checkpoint folder to cut lineage.

    Unlike a checkpoint such a table is compressed, is read by column and
    carries no constraints of the plan that made it, which would grow from round
    to round.  ``drop`` removes tables that nothing reads any more; what a write
    has shuffled goes with its end, instead of when the driver collects garbage.
    """

    def __init__(self, spark):
        _checkpoint_dir_set(spark)
        self.spark, self.numbers = spark, itertools.count()
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
        self.paths = {}

    def write(self, df) -> DataFrame:
        path = f"{self.folder}/{next(self.numbers)}"
        write_table(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables):
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
