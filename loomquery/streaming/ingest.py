"""Structured Streaming ingestion of a landing folder (an extension of ours)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomquery.plans.ship import ship
from loomquery.sources.collections import Collection

CHANGE = "id string, change string, text string, arrived timestamp"
#: The state store that keyed state needs.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def documents(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """A stream of whole text files: source, text, arrived."""
    read = spark.readStream.format("text").options(wholetext=True, pathGlobFilter=pattern, maxFilesPerTrigger=files_per_trigger).load(folder)
    return read.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def once(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Each text once, as far back as ``within``; state is dropped behind the watermark."""
    return stream.withColumn("h", F.md5("text")).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["h"]).drop("h")


def ingest(stream: DataFrame, step: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Each micro-batch processed and written; a write that is keyed by id may be repeated safely."""
    return stream.writeStream.foreachBatch(lambda df, _: write(step(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Changes(StatefulProcessor):
    """Of each id the digest of its last text; a row where it is new or another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a row without a time of arrival counts as the last
        newest = max(rows, key=lambda r: (r["arrived"] is None, r["arrived"] or datetime.min, r["text"] or ""))
        text, arrived = newest["text"] or "", newest["arrived"]
        digest = hashlib.sha256(text.encode()).hexdigest()
        known = self.last.get() if self.last.exists() else None
        if known is None or known[0] != digest:
            self.last.update((digest,))
            yield Row(id=key[0], change="insert" if known is None else "update", text=text, arrived=arrived)

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """(id, change, text, arrived) of a stream (id, text, arrived): ``insert`` for a new id, ``update`` for another text, nothing for the same.

    Of several rows of one id in a batch the last to arrive counts (of those that arrive together the greatest text). State is one digest an id,
    kept as long as the checkpoint, so a restart goes on where it was.
    """
    ship(stream.sparkSession)
    stream.sparkSession.conf.set(_STORE, _ROCKS)
    keyed = stream.select(F.col("id").cast("string").alias("id"), "text", "arrived").filter("id is not null").groupBy("id")
    return keyed.transformWithState(statefulProcessor=_Changes(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def follow(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "landing") -> StreamingQuery:
    """Keep a collection up to date with a stream (id, text, arrived): each batch's changes are one version of it.

    The version names stream and batch, and a batch that is named already is passed by, so a batch that is run again after a failure
    changes nothing. A new checkpoint needs a new ``name``.
    """

    def write(batch: DataFrame, number: int) -> None:
        meta = F.create_map(F.lit("change"), F.col("change"), F.lit("arrived"), F.date_format("arrived", "yyyy-MM-dd'T'HH:mm:ss"))
        collection.upsert(batch.select("id", F.col("text").alias("document"), meta.alias("metadata")), once=(name, number))

    return changes(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
