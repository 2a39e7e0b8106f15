"""What each session was served, as a stream with state.

A session's references are kept in the order first served, whatever order calls
arrive in.  A new stream starts from the log: what was served before is its
initial state.  A session that is quiet for long enough is closed by a timer,
which emits it once more and drops its state; calls after that start anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from knotlog.streaming.collector import CALLS

#: What the state store has to be for state with timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SESSIONS = "session string, served array<string>, calls long, closed boolean"
_FIRST = "at long, call string, place int"


class Served(StatefulProcessor):
    """The first time of each reference of a session, and a timer since its last call."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Names the state."""
        self.handle = handle
        self.first = handle.getMapState("first", "ref string", _FIRST)
        self.calls = handle.getValueState("calls", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def _keep(self, ref: str, at: int, call: str, place: int) -> None:
        old = self.first.getValue((ref,)) if self.first.containsKey((ref,)) else None
        if old is None or (at, call, place) < tuple(old):
            self.first.updateValue((ref,), (at, call, place))

    def _row(self, key: tuple, closed: bool) -> Row:
        order = sorted((tuple(v), k[0]) for k, v in self.first.iterator())
        n = self.calls.get()[0] if self.calls.exists() else 0
        return Row(session=key[0], served=[ref for _, ref in order], calls=n, closed=closed)

    def _wake(self, at_ms: int) -> None:
        """Moves the session's timer to ``idle`` after a time, if that is later."""
        due = at_ms + self.idle_ms
        if self.timer.exists():
            if self.timer.get()[0] >= due:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((due,))
        self.handle.registerTimer(due)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  the interface's names
        """What the log has of the session."""
        for x in initialState.first:
            self._keep(x["ref"], x["at"], x["call"], x["place"])
        self.calls.update((initialState.calls,))
        self._wake(initialState.last // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """New calls; the session as it is now."""
        n = self.calls.get()[0] if self.calls.exists() else 0
        for r in rows:
            n += 1
            for place, ref in enumerate(r.served or []):
                self._keep(ref, r.micros, r.call, place)
            self._wake(r.micros // 1000)
        self.calls.update((n,))
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """The session is over."""
        yield self._row(key, True)
        self.first.clear()
        self.calls.clear()
        self.timer.clear()

    def close(self) -> None:
        """Nothing is held beside the state."""


def replayed(calls: DataFrame) -> DataFrame:
    """Calls of the log as initial state: ``session, first, calls, last``."""
    calls = calls.withColumn("micros", F.unix_micros("created_at"))
    each = calls.select("session", "micros", "call", F.posexplode_outer("served").alias("place", "ref"))
    first = each.where("ref IS NOT NULL").groupBy("session", "ref").agg(F.min(F.struct(F.col("micros").alias("at"), "call", "place")).alias("o")).groupBy("session").agg(F.collect_list(F.struct("ref", "o.at", "o.call", "o.place")).alias("first"))
    sums = calls.groupBy("session").agg(F.count("*").alias("calls"), F.max("micros").alias("last"))
    empty = F.array().cast("array<struct<ref:string,at:bigint,call:string,place:int>>")
    return sums.join(first, "session", "left").select("session", F.coalesce("first", empty).alias("first"), "calls", "last")


def served_stream(calls: DataFrame, idle_ms: int = 3_600_000, late: str = "10 minutes", log: DataFrame | None = None) -> DataFrame:
    """A stream of calls as ``session, served, calls, closed``, one row for each session that a batch touched or closed."""
    grouped = calls.where("session IS NOT NULL AND created_at IS NOT NULL").withColumn("micros", F.unix_micros("created_at")).withWatermark("created_at", late).groupBy("session")
    start = replayed(log.where("session IS NOT NULL AND created_at IS NOT NULL")).groupBy("session") if log is not None else None
    return grouped.transformWithState(Served(idle_ms), SESSIONS, "Update", "EventTime", start)


def follow_sessions(spark: SparkSession, source: str, target: str, checkpoint: str, log: DataFrame | None = None, idle_ms: int = 3_600_000, late: str = "10 minutes", files_per_trigger: int = 64, batches: bool = False) -> StreamingQuery:
    """Streams a folder of JSON calls into ``target``, a folder for each batch, overwritten if it runs again.

    A query that was stopped goes on from its checkpoint; a new checkpoint
    starts from ``log``, the calls there were before.
    """
    calls = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", files_per_trigger).json(source)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = served_stream(calls, idle_ms, late, log).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer if batches else writer.trigger(availableNow=True)).start()


def latest_sessions(spark: SparkSession, target: str) -> DataFrame:
    """The last row of each session that a stream has written."""
    last = Window.partitionBy("session").orderBy(F.col("batch").desc(), "closed")
    return spark.read.parquet(target).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
