"""Sinks: consistent versions of all tables, and the run history."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = {"postings": ["ats"], "posting_text": ["ats"], "job_events": ["day"]}


def write_corpus(tables: dict[str, DataFrame], root: str, version: str | None = None) -> str:
    """Write every table under a new version, then publish it.

    Readers follow the newest published version, so they never see half of one;
    a job that dies half way leaves a version nobody points at.
    """
    version = version or str(int(time.time() * 1000))
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        by = [c for c in PARTITIONS.get(name, []) if c in df.columns]
        # Rebalancing groups rows by partition value and lets AQE split a value that holds
        # most of the table and merge small ones, so files come out even.
        out = df.hint("rebalance", *by) if by else df
        writer = out.write.mode("error")
        (writer.partitionBy(*by) if by else writer).parquet(f"{root}/v={version}/{name}")
    publish(spark, root, int(version))
    return version


def publish(spark: SparkSession, root: str, version: int) -> None:
    """The last step of a version: from now on readers follow it."""
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/_published")


def published_version(spark: SparkSession, root: str) -> int:
    """The newest published version; 0 where nothing is published."""
    try:
        return spark.read.schema("version long").parquet(f"{root}/_published").agg(F.max("version")).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    version = published_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/v={version}/{name}")


def append_run_history(run: DataFrame, path: str) -> None:
    """One JSON line per daily run."""
    run.coalesce(1).write.mode("append").json(path)
