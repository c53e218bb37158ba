"""Session defaults and lineage cutting."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, memory="8g", app="gridloom"):
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _checkpoint_dir_set(spark):
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str):
    """Write a table; what was shuffled for it goes with the end of the write, instead of when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def scratch_folder(spark) -> str:
    """Folder for intermediate tables and files that all executors share: that of ``spark.checkpoint.dir``."""
    _checkpoint_dir_set(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shuffled(df: DataFrame) -> DataFrame:
    """Side of a join that has about as many rows as a plane: it is dealt out by key, never broadcast.

    The planner takes a table's file size, or that of what an explode started from,
    for the size of its rows.  For dense grids both are a hundred times too small,
    and the driver would be given millions of rows to broadcast.
    """
    return df.hint("merge")


def bound_tasks(spark):
    """Let a task of this session read at most some 16 MB of shuffled rows, unless the session says otherwise.

    Dense grids take a tenth of a row's memory in a shuffle, so Spark's own 64 MB
    are gigabytes to sort; and a fixed number of partitions would grow with the
    input.  Small exchanges are put together again by adaptive execution.
    """
    for key, value in (("advisoryPartitionSizeInBytes", "16m"), ("coalescePartitions.initialPartitionNum", "1024")):
        if spark.conf.get(f"spark.sql.adaptive.{key}", None) in (None, str(64 << 20), f"{64 << 20}b"):
            spark.conf.set(f"spark.sql.adaptive.{key}", value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a result as a table in the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; what is
    in it survives executor loss.  Unlike a checkpoint the table is read by
    column and carries no constraints of the plan that made it, which would grow
    from round to round of an iteration.  Whoever runs a job clears the folder.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)
