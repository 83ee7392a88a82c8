"""Registered queries: a Spark job over the driver's tables and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the partitions that ``spark.jobtide.inputPartitions`` names, else over as many as a shuffle has.

    A table may be one file of few row groups, which only as many tasks can scan:
    without this, all work a row that follows would be theirs.
    """
    spark = df.sparkSession
    return df.repartition(int(spark.conf.get("spark.jobtide.inputPartitions", None) or spark.conf.get("spark.sql.shuffle.partitions")))
