"""Streams with typed state: which groups have gone stale, and uploads with their attempts, retries and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.workers import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which typed state needs."""
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, old)


STALE_OUT = "key long, stale boolean, made_at timestamp, fed_at timestamp"


class Staleness(StatefulProcessor):
    """Of each key when something was last made of its sources, and when it last got one.

    The greatest times count, so late rows, repeated ones and any order of rows come to the same. A
    row is given out when the verdict changes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("times", "made_at timestamp, fed_at timestamp, stale boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803  Spark's names
        made, fed, was = self.state.get() if self.state.exists() else (None, None, False)
        first = made is None
        for part in rows:
            for is_made, at in zip(part["made"], part["at"]):
                if pd.isna(at):
                    continue
                at = at.to_pydatetime()
                if is_made:
                    made = at if made is None else max(made, at)
                else:
                    fed = at if fed is None else max(fed, at)
        stale = made is not None and fed is not None and fed > made
        if (made, fed) != (None, None):
            self.state.update((made, fed, stale))
        if stale != was or first and made is not None:
            yield pd.DataFrame({"key": [key[0]], "stale": [stale], "made_at": pd.to_datetime([made]), "fed_at": pd.to_datetime([fed])})

    def close(self) -> None:
        pass


def staleness(rows: DataFrame, key: str, made: str, at: str) -> DataFrame:
    """(key, stale, made_at, fed_at) as verdicts change, of a stream of rows that say what was made (``made`` true) or came in."""
    ship(rows.sparkSession)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(made), F.lit(False)).alias("made"), F.col(at).cast("timestamp").alias("at")).where("key is not null")
    return rows.groupBy("key").transformWithStateInPandas(Staleness(), STALE_OUT, "Update", "None")


UPLOADS_OUT = "source_id long, status string, attempts int, at timestamp"
#: Seconds after a failed attempt until the next is due, doubled with each, and attempts after which a source is given up.
RETRY_AFTER, MOST_ATTEMPTS = 600, 4


class Uploads(StatefulProcessor):
    """Attempts to upload a source: it ends as uploaded, or given up after MOST_ATTEMPTS errors.

    After an error a timer says when the next attempt is due (RETRY_AFTER seconds, doubled each
    time, by the rows' times); an attempt before then puts it off. An attempt whose number was seen changes
    nothing, so replayed rows don't count twice.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", "status string, attempts int")
        self.seen = handle.getMapState("seen", "attempt long", "outcome string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803  Spark's names
        status, attempts = self.state.get() if self.state.exists() else ("pending", 0)
        was, last = (status, attempts), None
        for row in pd.concat(list(rows)).sort_values(["at", "attempt"]).itertuples():
            number = (int(row.attempt),)
            if self.seen.containsKey(number) or status in ("uploaded", "given_up"):
                continue
            self.seen.updateValue(number, (row.outcome,))
            attempts, last = attempts + 1, row.at
            status = {"ok": "uploaded", "abstract": "abstract_only"}.get(row.outcome) or ("given_up" if attempts >= MOST_ATTEMPTS else "error")
        if (status, attempts) == was:
            return
        self.state.update((status, attempts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "error":
            self.handle.registerTimer(int(last.timestamp() * 1000) + RETRY_AFTER * 1000 * 2 ** (attempts - 1))
        yield pd.DataFrame({"source_id": [key[0]], "status": [status], "attempts": [attempts], "at": pd.to_datetime([last])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        _, attempts = self.state.get()
        at = pd.to_datetime([expiredTimerInfo.getExpiryTimeInMs()], unit="ms")
        yield pd.DataFrame({"source_id": [key[0]], "status": ["due"], "attempts": [attempts], "at": at})

    def close(self) -> None:
        pass


def uploads(attempts: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(source_id, status, attempts, at) of a stream of (source_id, attempt, outcome, at): each change, and "due" when a retry is."""
    ship(attempts.sparkSession)
    rows = attempts.select(F.col("source_id").cast("long").alias("source_id"), F.col("attempt").cast("long").alias("attempt"), "outcome", F.col("at").cast("timestamp").alias("at")).where("source_id is not null and attempt is not null and at is not null")
    return rows.withWatermark("at", delay).groupBy("source_id").transformWithStateInPandas(Uploads(), UPLOADS_OUT, "Update", "EventTime")
