"""Session set-up and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "jobtide", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster use the submitted one."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("JOBTIDE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # Recording a Python stack per column expression costs seconds on wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions:
        # Small single-file tables are dealt over as many tasks before heavy row-local work.
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.jobtide.inputPartitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a table in the shared folder, so a lost executor costs one task.

    Used where several outputs hang off one expensive plan; reading the table
    back keeps column pruning and predicate pushdown for each of them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/jobtide/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
