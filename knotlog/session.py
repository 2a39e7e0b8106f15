"""Session settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC so that time literals mean the same everywhere; adaptive execution so
#: that partition counts and skewed joins follow the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "knotlog", **more: str) -> SparkSession:
    """A session with ``SETTINGS``; master and sizes come from the submitter."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of input (as the optimizer estimates them) up to which rows are dealt out anew.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores, for work that is much for each row.

    A file of one row group is one task, however many cores wait; larger tables
    have tasks enough and stay as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df
