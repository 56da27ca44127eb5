"""Walk reports as a stream: validated ingest, late clocks, deduplication, open and closed walks."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.validate import clean_reports
from ..sources.reports import MAX_SHARED, REPORT, bounded_log, read_or_empty


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(REPORT).json(path)


def cleaned(stream: DataFrame, now_ms: int | None = None) -> DataFrame:
    """The server's form; clocks a day or more off are set to the present, late rows are never dropped."""
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    return clean_reports(stream, now)


def append_log(stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Appends to a Parquet log, exactly once with its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, *, most: int = MAX_SHARED, order: str = "at") -> StreamingQuery:
    """A log that never holds more than its ``most`` newest rows: each batch writes a snapshot of the newest
    rows of the one before and its own, and deletes the one before that. A batch that is run again
    writes the same snapshot. Read it with :func:`read_log`."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_or_empty(spark, f"{path}/snapshot={number - 1}", batch.schema)
        bounded_log(before.unionByName(batch), most, order=order).write.mode("overwrite").parquet(f"{path}/snapshot={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest snapshot."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("snapshot")).first()[0]
    return rows.where(F.col("snapshot") == newest).drop("snapshot")


#: Answers of a shared log are kept for so long.
KEPT_SECONDS = 60


def kept_read(rows: DataFrame, path: str, *, seconds: float = KEPT_SECONDS, now: float | None = None) -> DataFrame:
    """``rows`` as they were read at most ``seconds`` ago: the newest answer kept under ``path``, or a new one.

    Answers are folders named by the moment (in ms) they were written; a new one is only seen once it is whole,
    and the one before the last is deleted. ``now`` in seconds is the clock's time unless given.
    """
    spark, moment = rows.sparkSession, int((time.time() if now is None else now) * 1000)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [x.getPath() for x in store.listStatus(folder)] if store.exists(folder) else []
    whole = sorted(((int(x.getName()), x) for x in there if x.getName().isdigit() and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))), key=lambda x: x[0])
    if not whole or moment - whole[-1][0] >= seconds * 1000:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{moment}")
        for _, old in whole[:-1]:
            store.delete(old, True)
        return spark.read.schema(rows.schema).parquet(f"{path.rstrip('/')}/{moment}")
    return spark.read.schema(rows.schema).parquet(whole[-1][1].toString())


def deduplicated(stream: DataFrame, horizon: str = "1 day") -> DataFrame:
    """One row a (from, to, at, seconds) within a horizon of event time; an optional variant that bounds state."""
    timed = stream.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", horizon)
    return timed.dropDuplicatesWithinWatermark(["from", "to", "at", "seconds"])


CLOSED = "walk_id string, started_at long, ended_at long, outcome string"


#: A walk without an arrival expires after so long.
HOUR_MS = 3_600_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["walk_id", "started_at", "ended_at", "outcome"]).astype({"ended_at": "Int64"})


class WalkStates(StatefulProcessor):
    """A start opens a walk; an arrival closes it; an hour of event time without one expires it, by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        before = started = self.open.get()[0] if self.open.exists() else None
        out = []
        for batch in rows:
            for kind, at in batch.sort_values("at")[["kind", "at"]].itertuples(index=False):
                if kind == "start":
                    started = int(at)
                elif started is not None:
                    out.append((key[0], started, int(at), "arrived"))
                    started = None
        if started != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if started is None:
                self.open.clear()
            else:
                self.open.update((started,))
                self.handle.registerTimer(max(started + HOUR_MS, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield _told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        started = self.open.get()[0]
        self.open.clear()
        yield _told([(key[0], started, None, "expired")])

    def close(self) -> None:
        pass


def closed_walks(events: DataFrame) -> DataFrame:
    """A stream of (walk_id, kind start|arrive, at) to closed or expired walks.

    The state is one long a walk that is open. Sets the session's state store to RocksDB, whose keys need not fit
    in memory: timers have no other. A running stream keeps the store that its checkpoint names.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    timed = events.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", "1 minute")
    return timed.groupBy("walk_id").transformWithStateInPandas(WalkStates(), CLOSED, "append", "EventTime")
