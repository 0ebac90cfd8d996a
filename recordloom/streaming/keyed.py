"""Keyed state of feeds on a stream: the last row of each key, and sources that may only grow.

State is kept by Spark (in RocksDB, checkpointed with the query), a small row for each key, so a micro-batch costs what it brings and not what was stored before. The result is a log
of changes that is only appended to; readers take the last change of each key (latest_of_log). A query that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

c = F.col
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which processors with timers need; the session's setting is put back."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


class LastRow(StatefulProcessor):
    """Of each key the last row by ``order`` and a change for each micro-batch that brings a later one: added, changed, or same (repeated with equal fields).

    Rows not later than the stored one change nothing, so rows out of order and rows brought again are harmless. With ``idle_ms`` a key's state goes when the watermark has passed its last
    event by that much; a row that comes later still is logged as added.
    """

    def __init__(self, key: str, order: str, fields: list[str], schema: StructType, event_time: str | None = None, idle_ms: int | None = None):
        self.key, self.order, self.fields, self.schema, self.event_time, self.idle_ms = key, order, fields, schema, event_time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = [self.schema[f] for f in (self.order, *self.fields)]
        timed = [StructField("_last_ms", LongType())] if self.idle_ms is not None else []
        self.last = handle.getValueState("last", StructType(kept + timed))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.last.get() if self.last.exists() else None
        new, seen_ms = None, -1
        for row in rows:
            if self.idle_ms is not None and row[self.event_time] is not None:
                seen_ms = max(seen_ms, int(row[self.event_time].timestamp() * 1000))
            if row[self.order] is not None and (new is None or row[self.order] >= new[self.order]):
                new = row
        if new is None:
            return
        stored_ms = old[len(self.fields) + 1] if old is not None and self.idle_ms is not None else -1
        later = old is None or new[self.order] > old[0]
        values = tuple(new[f] for f in self.fields) if later else tuple(old[1 : len(self.fields) + 1])
        order = new[self.order] if later else old[0]
        if self.idle_ms is None:
            if later:
                self.last.update((order, *values))
        else:
            last_ms = max(stored_ms, seen_ms)
            self.last.update((order, *values, last_ms))
            if last_ms > stored_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer[0] if isinstance(timer, tuple | list) else timer)
                self.handle.registerTimer(last_ms + self.idle_ms)
        if later:
            change = "added" if old is None else "same" if tuple(old[1 : len(self.fields) + 1]) == values else "changed"
            yield Row(**{self.key: key[0], "change": change, self.order: order, **dict(zip(self.fields, values))})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def feed_changes(rows: DataFrame, key: str, order: str, fields: list[str], event_time: str | None = None, late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream of rows -> a stream of changes: key, change, order, fields.

    With ``event_time`` and ``late`` rows older than the watermark are dropped; with ``idle_ms`` too the state of keys without events for so long (by the watermark) is freed. Without them
    every row counts and state is one row for each key. Rows without a key or an order change nothing.
    """
    names = list(dict.fromkeys([key, order, *fields, *([event_time] if event_time else [])]))
    rows = rows.select(*names).filter(c(key).isNotNull())
    if event_time and late:
        rows = rows.withWatermark(event_time, late)
    schema = rows.schema
    out = StructType([schema[key], StructField("change", StringType()), schema[order], *(schema[f] for f in fields)])
    timed = idle_ms is not None and event_time is not None and late is not None
    processor = LastRow(key, order, fields, StructType([StructField(f.name, f.dataType) for f in schema]), event_time, idle_ms if timed else None)
    return rows.groupBy(key).transformWithState(processor, out, "Append", "EventTime" if timed else "None")


class OnlyGrows(StatefulProcessor):
    """Of each record of a source what it was first like; a record that comes again with other content is a violation, one with the same content is repeated."""

    def __init__(self, content: str):
        self.content = content

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", StructType([StructField("digest", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        digest = self.first.get()[0] if self.first.exists() else None
        counts: dict[str, int] = {}
        for row in sorted(rows, key=lambda r: (r["_file"], r[self.content])):  # the first file's content counts
            if digest is None:
                digest = row[self.content]
                self.first.update((digest,))
                kind = "added"
            else:
                kind = "repeated" if row[self.content] == digest else "violation"
            counts[kind] = counts.get(kind, 0) + 1
        for kind, n in sorted(counts.items()):
            yield Row(source=key[0], local_id=key[1], change=kind, n=n)

    def close(self) -> None:
        pass


def append_only_changes(records: DataFrame, fields: list[str]) -> DataFrame:
    """A stream of records (source, local_id, fields, and _file: the name of the file that brought them, in whose order they count) -> source, local_id, change (added, repeated or violation), n."""
    digest = F.sha2(F.to_json(F.struct(*(F.coalesce(c(f).cast("string"), F.lit("")).alias(f) for f in fields))), 256)
    keyed = records.filter("source is not null and local_id is not null").select("source", "local_id", "_file", digest.alias("digest"))
    return keyed.groupBy("source", "local_id").transformWithState(OnlyGrows("digest"), "source string, local_id string, change string, n long", "Append", "None")


def append_log(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Changes appended as Parquet files, each micro-batch once."""
    with keyed_state(changes.sparkSession):
        return changes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_of_log(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The last change of each key. The order of the log's files doesn't matter."""
    log = spark.read.parquet(path)
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("_r")).select("_r.*")
