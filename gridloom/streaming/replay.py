"""Run a stream over the files present and read its result back."""

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import _checkpoint_dir_set

END = "9000-01-01 00:00:00"  # past every event


def run_files(parts, make) -> DataFrame:
    """Replay tables one after the other, one a micro-batch, into a single result.

    ``parts`` are frames of one schema, in order of arrival; ``make`` maps their
    stream to the result.
    """
    spark, root = parts[0].sparkSession, _root(parts[0].sparkSession)
    spark.createDataFrame([], parts[0].schema).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(parts[0].schema).parquet(f"{root}/in")
    result = make(stream)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = _run(result, root)
    return out


def stream_table(spark, folder: str, name: str) -> DataFrame:
    """A table's parquet files as a file stream."""
    path = os.path.join(folder, f"{name}.parquet")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def _root(spark) -> str:
    """A new folder in the shared one."""
    _checkpoint_dir_set(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(result: DataFrame, root: str, mode="append") -> DataFrame:
    query = (
        result.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{root}/out")


def run_available(result: DataFrame, mode="append") -> DataFrame:
    """Process everything available into a table in the shared folder."""
    return _run(result, _root(result.sparkSession), mode)


def run_closed(spark, folder: str, name: str, windows, time="ts") -> DataFrame:
    """All windows of a table's replay, also those still open at its end.

    ``windows`` maps the stream to its windows.  Append mode returns a window
    once the watermark is past it, so after the files the same query goes on
    with one row at ``END``; its own window stays open and is not returned.
    """
    root, table = _root(spark), stream_table(spark, folder, name)
    closing = f"{root}/closing"
    spark.createDataFrame([], table.schema).write.parquet(closing)
    result = windows(table.unionByName(spark.readStream.schema(table.schema).parquet(closing)))
    _run(result, root)
    last = [F.lit(END if c.name == time else None).cast(c.dataType).alias(c.name) for c in table.schema]
    spark.range(1).select(*last).write.mode("append").parquet(closing)
    return _run(result, root)
