"""Tables written between steps, in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made so far, in order; what ``scoped`` and the interpreter's exit remove.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="knotlog-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed with the scope or process it is made in."""
    path = f"{shared_dir(spark)}/knotlog-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; its lineage ends there.

    With ``few``, exchanges before it are coalesced to the advisory size rather
    than to the cores, so that a small table is few files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key, None)
    if few:
        spark.conf.set(key, "false")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if few:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders by the file system that Spark itself uses for them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables written inside; nothing lazy may read them later."""
    first = len(_MADE)
    try:
        yield
    finally:
        own = _MADE[first:]
        del _MADE[first:]
        remove(spark, own)


@atexit.register
def _at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession() if _MADE else None
        if spark is not None and spark.sparkContext._jsc is not None:
            remove(spark, _MADE)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass
