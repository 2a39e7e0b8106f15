"""Observations as a stream into the log, and incremental scans.

A call of a session becomes one observation and links: the session contains the
call, the call belongs to the session, and the call served each reference.
Back-pressure takes the place of dropping: files wait until they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CALLS = "session string, call string, tool string, created_at timestamp, served array<string>"
LINKS = "src_ref string, edge_type string, dst_ref string, created_at timestamp"


def observations(calls: DataFrame) -> DataFrame:
    """``id, action, subject, created_at``: each session once, and each call."""
    sessions = calls.groupBy("session").agg(F.min("created_at").alias("created_at")).select(F.col("session").alias("id"), F.lit("session").alias("action"), F.lit("").alias("subject"), "created_at")
    own = calls.dropDuplicates(["call"]).select(F.col("call").alias("id"), F.lit("call").alias("action"), F.col("tool").alias("subject"), "created_at")
    return sessions.unionByName(own)


def call_links(calls: DataFrame) -> DataFrame:
    """Links of each call, in one pass over the calls."""
    s, c = F.concat(F.lit("o:"), "session"), F.concat(F.lit("o:"), "call")
    link = lambda a, e, b: F.struct(a.alias("src_ref"), F.lit(e).alias("edge_type"), b.alias("dst_ref"))
    fixed = F.array(link(s, "contains", c), link(c, "belongs_to", s))
    served = F.transform(F.coalesce("served", F.array().cast("array<string>")), lambda r: link(c, "served", r))
    return calls.select("created_at", F.explode(F.concat(fixed, served)).alias("x")).select("x.*", "created_at")


def collect_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 64, once: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Streams a folder of JSON calls into ``target/observations`` and ``target/links``.

    A batch's folders are named by its number and overwritten, so a batch that
    runs again after a failure is written once.
    """
    calls = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", files_per_trigger).json(source)

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        observations(batch).write.mode("overwrite").parquet(f"{target}/observations/batch={number}")
        call_links(batch).write.mode("overwrite").parquet(f"{target}/links/batch={number}")
        batch.unpersist()

    writer = calls.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def new_sessions(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's sessions, each once within a watermark."""
    return calls.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["session"]).select("session", "created_at")


def activity(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls of each tool in tumbling windows; late rows are dropped."""
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", width), "tool").agg(F.count("*").alias("calls"))


def watch(spark: SparkSession, root: str, checkpoint: str, on_files: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``on_files`` over files that are new under a root, one batch at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return files.writeStream.foreachBatch(on_files).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def served_in_order(calls: DataFrame) -> DataFrame:
    """``session, served``: each reference once, in the order first served."""
    each = calls.select("session", "created_at", "call", F.posexplode("served").alias("at", "ref"))
    first = each.groupBy("session", "ref").agg(F.min(F.struct("created_at", "call", "at")).alias("o"))
    return first.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "ref"))), lambda x: x["ref"]).alias("served"))
