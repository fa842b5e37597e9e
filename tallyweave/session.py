"""Session settings and durable lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SECONDS_BETWEEN_COLLECTIONS = 15.0
_collected = [0.0]


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and single-node runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset a local
    master gets a temporary folder; any other master is an error, because a
    machine-local folder is not visible to the other executors.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tallyweave-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This runs the plan once, ends its lineage and survives the loss of an
    executor. Being Parquet, later reads fetch only the columns they need.
    """
    spark = df.sparkSession
    # Spark 4.1 may combine the partitionings of union branches that adaptive execution has coalesced to
    # different numbers, and then refuses the plan ("PartitioningCollection requires ...").
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def drop(*tables: DataFrame, now: bool = False) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more.

    Call it once their successor is written. Now and then shuffle files whose plans
    are gone go with them, as the driver collects its garbage: at once with ``now``,
    for steps that shuffled much.
    """
    paths = [t.__dict__.pop("_cut_path", None) for t in tables]
    for path, table in zip(paths, tables):
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if any(paths) and (now or time.monotonic() - _collected[0] > SECONDS_BETWEEN_COLLECTIONS):
        _collected[0] = time.monotonic()
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
