"""States that a stream keeps by key: captures as their actions come, and listings that are held for a time.

Both are processors with a value in the state store for each key; a restart goes on from the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

#: What an action makes of a status; others change nothing.
MOVES = {("inbox", "route"): "routed", ("inbox", "archive"): "archived", ("routed", "undo"): "inbox"}
CAPTURES = "id {id}, status string, at timestamp, steps long"
TTL_SECONDS = 600
#: The state store that such processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


class Captures(StatefulProcessor):
    """Walks each capture's actions in order; a batch's actions come after those of the batches before."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("capture", "status string, at timestamp, steps long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, at, steps = self.state.get() if self.state.exists() else ("inbox", None, 0)
        own = pd.concat(list(rows)).sort_values(["at", "seq", "action"])
        for action, when in zip(own["action"], own["at"], strict=True):
            if (moved := MOVES.get((status, action))) is not None:
                status, at, steps = moved, when.to_pydatetime(), steps + 1
        self.state.update((status, at, steps))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "at": pd.Series([at], dtype="datetime64[us]"), "steps": [steps]})

    def close(self) -> None:
        pass


class Held(StatefulProcessor):
    """Keeps each key's newest value, and drops it when the time of the stream has gone ``ttl`` seconds past it."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "value string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "value"])
        value, until = own["value"].iloc[-1], int(own["at"].iloc[-1].timestamp() * 1000) + self.ttl * 1000
        if self.state.exists():
            had, before = self.state.get()
            if before > until:
                value, until = had, before
            self.handle.deleteTimer(before)
        self.state.update((value, until))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "held": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "value": [value], "held": [False]})

    def close(self) -> None:
        pass


def capture_changes(log: DataFrame) -> DataFrame:
    """(id, status, at, steps) of each capture as of each batch of a stream (id, action, at, seq), by the rules of ``operators.state.capture_states``.

    Actions of later batches must not be earlier than those before; a task holds the actions that one batch has for one capture.
    """
    kind = log.schema["id"].dataType.simpleString()
    return log.groupBy("id").transformWithStateInPandas(Captures(), CAPTURES.format(id=kind), "Update", "None")


def held_for(listings: DataFrame, ttl: int = TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """(key, value, held) of a stream of listings (key, value, at): a row when a value is kept, and one with ``held`` false when it is no longer fresh."""
    kind = listings.schema["key"].dataType.simpleString()
    return listings.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Held(ttl), f"key {kind}, value string, held boolean", "Update", "EventTime")


def run_to_end(stream: DataFrame, folder: str) -> None:
    """Runs a stream of such states over all that is there; each batch's rows are written to ``folder`` with the batch's number, again if it runs again."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def newest(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """The last row that was written for each key."""
    out = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
