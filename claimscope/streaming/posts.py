"""Streams of posts and clicks: deduplication, toggles, bounded runs for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def first_seen(posts: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each post once, however often it is observed within the watermark."""
    return posts.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class Toggle(StatefulProcessor):
    """Per post: the number of clicks; the table is built by the first, and each click shows or hides it.

    A repeated ``event_id`` counts once, as in the batch form: the ids of a post's events are part of its state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clicks = handle.getValueState("clicks", "clicks long")
        self.events = handle.getMapState("events", "event_id long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.clicks.get()[0] if self.clicks.exists() else 0
        for r in rows:
            for event in r["event_id"].unique().tolist():
                if not self.events.containsKey((event,)):
                    self.events.updateValue((event,), (1,))
                    now += 1
        self.clicks.update((now,))
        yield pd.DataFrame({"post_id": [key[0]], "clicks": [now], "built": [now > 0], "visible": [now % 2 == 1]})

    def close(self) -> None:
        pass


def toggles(clicks: DataFrame) -> DataFrame:
    """Stream of states (post_id, clicks, built, visible) from clicks (post_id, event_id)."""
    return clicks.groupBy("post_id").transformWithStateInPandas(Toggle(), "post_id string, clicks long, built boolean, visible boolean", "Update", "None")


class ExpiringToggle(StatefulProcessor):
    """As ``Toggle``, with state that ends.

    An event id is kept until the watermark passes its event's time: a repetition after that is late. Late events change
    nothing and come out as rows of kind ``late``. A post without events for ``idle_ms`` of event time gives its last
    state once more as kind ``expired``, and its state is removed; a click after that starts anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clicks = handle.getValueState("clicks", "clicks long, last long")
        self.events = handle.getListState("held", "event_id long, at long")  # read and written as a whole: a call a post, not one an event

    def _row(self, key, kind: str, clicks: int, event: int | None, at: int) -> dict:
        return {"post_id": key[0], "kind": kind, "event_id": event, "at": at, "clicks": clicks, "built": clicks > 0, "visible": clicks % 2 == 1}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        known = self.clicks.exists()
        clicks, last = self.clicks.get() if known else (0, -1)
        held = dict(self.events.get()) if known else {}
        late, before = [], clicks
        for r in rows:
            for event, at, real in zip(r["event_id"].tolist(), r["at"].tolist(), r["known"].tolist(), strict=True):
                if not real:
                    continue
                if at <= passed:
                    late.append((event, at))
                elif event not in held:
                    held[event] = at
                    clicks, last = clicks + 1, max(last, at)
        out = [self._row(key, "late", clicks, event, at) for event, at in late]
        if clicks > before:
            for t in list(self.handle.listTimers()) if known else ():
                self.handle.deleteTimer(t)
            self.clicks.update((clicks, last))
            # the next id to be dropped, or the end of the post
            self.handle.registerTimer(min(self._kept(held, passed), default=last + self.idle_ms))
            out.append(self._row(key, "state", clicks, None, last))
        if out:
            yield pd.DataFrame(out).astype({"event_id": "Int64"})

    def _kept(self, held: dict[int, int], passed: int) -> list[int]:
        """Hold the ids of events that the watermark has not passed, and no others; their times."""
        kept = [(event, at) for event, at in held.items() if at > passed]
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        return [at for _, at in kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        clicks, last = self.clicks.get()
        kept = self._kept(dict(self.events.get()), passed)
        if kept or passed < last + self.idle_ms:
            self.handle.registerTimer(min(kept, default=last + self.idle_ms))
            return
        self.clicks.clear()
        yield pd.DataFrame([self._row(key, "expired", clicks, None, last)]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


EXPIRING = "post_id string, kind string, event_id long, at long, clicks long, built boolean, visible boolean"


def expiring_toggles(clicks: DataFrame, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Stream of toggles with bounded state from clicks (post_id, event_id, ts): rows of kinds state, late and expired.

    ``late`` is the watermark's delay, ``idle`` how long a post's state stays after its last event; times come out in
    milliseconds. Rows without post, event id or time are no clicks, but their times move the clock. Ids of events are held for the delay only, whatever a post's number of clicks is. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = clicks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # without the marked column itself, which would let Spark drop late rows before the operator sees them; and without a
    # filter, which Spark would move before the clock
    zero = F.lit(0).cast("long")
    own = timed.select("post_id", F.coalesce("event_id", zero).alias("event_id"), F.coalesce(F.unix_millis("ts"), zero).alias("at"), (F.col("event_id").isNotNull() & F.col("ts").isNotNull()).alias("known"))
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return own.groupBy("post_id").transformWithStateInPandas(ExpiringToggle(ms), EXPIRING, "Append", "EventTime")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as map states and timers need it."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def latest_states(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, mode: str = "update", reader: SparkSession | None = None) -> DataFrame:
    """Run a stream of states over what its source holds now; of each key the state of greatest ``order``.

    Each micro-batch appends its states, so a repeated attempt of a batch changes nothing. The stream's session needs the
    RocksDB store (``stateful_session``); the result is read in ``reader``, or else in the same.
    """
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    sink.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start().awaitTermination()
    rows = (reader or stream.sparkSession).read.schema(stream.schema).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), order).alias("state")).select(*keys, "state.*")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, into Parquet; a processing-time trigger does the same for good."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_through(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream into a sink of micro-batches until its source has nothing more, then stop it.

    For sources that cannot tell their end beforehand, as those of Python that admit so much at a time.
    """
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def polled(stream: DataFrame, path: str, checkpoint: str, seconds: int = 4):
    """Run for good, one micro-batch every so many seconds; however often posts change meanwhile, they are read once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
