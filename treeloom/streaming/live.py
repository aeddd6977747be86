"""Live rebuilds: change events folded into batches, and generations that replace one another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.cut import WINDOW
from ..sources.changes import FolderChanges
from ..sources.scan import kept_path

DEBOUNCE = "300 milliseconds"


def source_events(events: DataFrame, path: Column | str = "path") -> DataFrame:
    """Events about files that count: no dot folders, no build folders. Batch or stream."""
    return events.filter(kept_path(F.col(path) if isinstance(path, str) else path, ("target", "node_modules")))


def sessions(events: DataFrame, gap: str = DEBOUNCE, lateness: str | None = None, *keys: str) -> DataFrame:
    """(keys, first, last, n) of events (ts) with no pause of more than a gap: what one rebuild answers. For streams,
    lateness is how long a late event is waited for."""
    rows = events.withWatermark("ts", lateness) if lateness else events
    # a stream's sessions need a key, and not a constant: those are taken out of the plan
    by = keys or (F.when(F.col("ts").isNotNull(), 0).alias("_all"),)
    found = rows.groupBy(*by, F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return found.drop("session_window", "_all")


def batches(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """sessions() of a table. Runs of events are folded where they lie before they are shuffled, key by key."""
    return sessions(events, gap, None, *keys)


def retained(remaps: DataFrame) -> DataFrame:
    """Remaps of the newest WINDOW generations."""
    newest = remaps.agg(F.max("generation").alias("newest"))
    return remaps.crossJoin(F.broadcast(newest)).filter(F.col("generation") > F.col("newest") - WINDOW).drop("newest")


class Stale(Exception):
    """A change that names no generation (400) or another than the live one (409)."""

    def __init__(self, status: int):
        super().__init__("missing generation" if status == 400 else "stale generation")
        self.status = status


@dataclass
class Generations:
    """The live generation. A rebuild that fails leaves it in place, sets `error`, and stays due."""

    load: Callable[[], Any]
    automatic: bool = True
    carry: Callable[[Any, Any], Any] | None = None  # (old, new): carries the cut over and returns what is served
    live: Any = None
    number: int = 0
    dirty: bool = False
    error: str | None = None
    _lock: Lock = field(default_factory=Lock, repr=False)

    def changed(self, frame: DataFrame | None = None, epoch: int = 0) -> bool:
        """A batch of events has closed (for foreachBatch): rebuild, or remember that one is due."""
        if frame is not None and frame.count() == 0:  # all of it: a look at some partitions would leave others' state behind
            return False
        self.dirty = True
        return self.rebuild() if self.automatic else False

    def rebuild(self) -> bool:
        """Build the next generation and swap it in; events that come meanwhile are the next batch's."""
        with self._lock:
            self.dirty = False
            try:
                fresh = self.load()
                fresh = self.carry(self.live, fresh) if self.carry and self.live is not None else fresh
            except Exception as problem:  # whatever a loader meets, the live generation goes on
                self.error, self.dirty = str(problem), True
                return False
            self.live, self.number, self.error = fresh, self.number + 1, None
            return True

    def check(self, generation: int | None) -> None:
        if generation is None:
            raise Stale(400)
        if generation != self.number:
            raise Stale(409)

    def status(self) -> dict[str, Any]:
        return {"generation": self.number, "mode": "auto" if self.automatic else "static", "dirty": self.dirty, "error": self.error}


class Debounce(StatefulProcessor):
    """One open batch of events; it closes when no event has come for a gap, by the clock and not by a later event."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        first, last, n = held if held is not None else (None, None, 0)
        for row in rows:
            first = row.micros if first is None else min(first, row.micros)
            last = row.micros if last is None else max(last, row.micros)
            n += 1
        self.open.update((first, last, n))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, n = self.open.get()
        self.open.clear()
        yield Row(first=first, last=last, n=n)

    def close(self) -> None:
        pass


#: Timers need this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def debounced(events: DataFrame, gap_ms: int = 300) -> DataFrame:
    """(first, last, n) of each batch of a stream of events (ts): a batch ends `gap_ms` after its last event."""
    events.sparkSession.conf.set(*STORE)
    keyed = events.select(F.unix_micros("ts").alias("micros"), F.when(F.col("ts").isNotNull(), 0).alias("all"))  # a constant would be taken out of the plan
    closed = keyed.groupBy("all").transformWithState(statefulProcessor=Debounce(gap_ms), outputStructType="first bigint, last bigint, n bigint", outputMode="Append", timeMode="ProcessingTime")
    return closed.select(F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the changes under a root, as (ts, path, change); changes before it starts are none."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", root).load()


def follow(events: DataFrame, generations: Generations, checkpoint: str, gap_ms: int = 300, every_ms: int = 100):
    """Start a query over a stream of events (ts, path) that rebuilds once for each batch, the last one too. Events that come
    while a generation is built are the next batch's."""
    closed = debounced(source_events(events), gap_ms)
    stream = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return stream.trigger(processingTime=f"{every_ms} milliseconds").foreachBatch(generations.changed).start()


def by_position(rows: DataFrame, gap_seconds: float, *keys: str) -> DataFrame:
    """sessions() by windows, for what must also see single events: rows with the number of their batch."""
    order = Window.partitionBy(*keys).orderBy("ts")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    return rows.withColumn("batch", F.sum(F.when(pause <= int(gap_seconds * 1e6), 0).otherwise(1)).over(order))
