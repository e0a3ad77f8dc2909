"""Streams: index upkeep, resumed work, deduplication and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.workers import ship
from ..operators.segments import SegmentedIndex


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sync_index(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], build: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "id"):
    """Keeps an index in step with changed rows: for each batch its ids' rows are replaced.

    ``write(index, batch_id)`` must put a whole version in place, so a batch that is run
    again after a failure gives the same index.
    """
    from ..operators.fts import sync

    def each(batch: DataFrame, batch_id: int) -> None:
        latest = batch.dropDuplicates([key])
        write(sync(read(), build(latest), latest.select(key), key), batch_id)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def sync_segments(changes: DataFrame, index: SegmentedIndex, checkpoint: str, at: str = "at", removed: str = "removed", name: str = "stream", merge: bool = True) -> StreamingQuery:
    """Keeps a segmented index in step with a stream of rows (key, fields, ``at``, ``removed``); runs over what there is and stops.

    Of a key's rows in a batch the latest counts (of several at one time the one that is greatest). A batch is
    a segment named by its number, so one that is run again changes nothing. Rows
    without a key are no documents.
    """
    about = index.manifest()
    key, fields = about["key"], about["fields"]

    def each(batch: DataFrame, batch_id: int) -> None:
        row = F.struct(at, removed, *fields)
        last = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_x")).select(key, "_x.*")
        last = last.withColumn(removed, F.coalesce(removed, F.lit(False)))
        index.apply(f"{name}-{batch_id:010d}", last.where(~F.col(removed)), last.where(F.col(removed)))
        if merge:
            index.merge()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(rows: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What is left to do of a stream or table."""
    return rows if force else rows.join(done.select(key), key, "left_anti")


def deduplicated(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, length: str, slide: str | None = None, at: str = "ts", by: tuple[str, ...] = ("event_type",), watermark: str | None = None) -> DataFrame:
    """Count and sum of values per window (tumbling, or sliding with ``slide``) and key; the same for batch and stream."""
    rows = events.withWatermark(at, watermark) if watermark else events
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, at: str = "ts", by: str = "user_id", watermark: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap."""
    rows = events.withWatermark(at, watermark) if watermark else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


UPLOAD_OUT = "source_id long, status string, attempts int, completed_at timestamp"
UPLOAD_STATE = "status string, attempts int, completed_at timestamp"


def upload_step(status: str, attempts: int, outcome: str) -> tuple[str, int]:
    """The state after an attempt: uploaded stays; abstract_only can still be uploaded; errors count."""
    if status == "uploaded":
        return status, attempts
    return {"ok": "uploaded", "abstract": "abstract_only"}.get(outcome, "error"), attempts + 1


def upload_states(attempts: DataFrame) -> DataFrame:
    """The latest upload state of each source, from a stream of (source_id, outcome, at)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, done = state.get if state.exists else ("pending", 0, None)
        for row in pd.concat(list(parts)).sort_values("at").itertuples():
            status, n = upload_step(status, n, row.outcome)
            done = row.at if status == "uploaded" and done is None else done
        state.update((status, n, done))
        yield pd.DataFrame({"source_id": [key[0]], "status": [status], "attempts": [n], "completed_at": [done]})

    ship(attempts.sparkSession)
    return attempts.groupBy("source_id").applyInPandasWithState(update, UPLOAD_OUT, UPLOAD_STATE, "update", GroupStateTimeout.NoTimeout)


def latest_state(rows: DataFrame, key: str, at: Column) -> DataFrame:
    """Of each key the last row: what a stream of changes comes to."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("_x")).select(key, *(F.col(f"_x.{c}").alias(c) for c in cols))
