"""Captures and held listings as streams with state."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import state
from gleanery.streaming import states

LOG = "id long, action string, at timestamp, seq long"


def test_captures_as_they_come_equal_the_whole_log(spark, tmp_path):
    """Over three runs of the stream, each of which goes on from the state of the last."""
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.choice(["route", "undo", "archive", "other"]), n) for n in range(300)]
    source, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/run"
    for part in range(3):
        own = spark.createDataFrame([(i, a, n) for i, a, n in rows[100 * part : 100 * part + 100]], "id long, action string, seq long")
        own.select("id", "action", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") / 2).cast("timestamp").alias("at"), "seq").coalesce(1).write.mode("append").parquet(source)
        stream = states.capture_changes(spark.readStream.schema(LOG).parquet(source))
        states.run_to_end(stream, folder)
        got = {tuple(r) for r in states.newest(stream, folder, "id").collect()}
        assert got == {tuple(r) for r in state.capture_states(spark.read.schema(LOG).parquet(source)).collect()}


def test_listings_expire(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    seen = []
    for k, rows in enumerate([[("a", "one", 0), ("b", "x", 10)], [("b", "y", 400)], [("c", "z", 700)], [("c", "z", 1200)]]):
        spark.createDataFrame(rows, "key string, value string, s long").select("key", "value", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("at")).coalesce(1).write.mode("append").parquet(source)
        stream = states.held_for(spark.readStream.schema("key string, value string, at timestamp").parquet(source))
        states.run_to_end(stream, folder)
        seen.append({r["key"]: (r["value"], r["held"]) for r in states.newest(stream, folder, "key").collect()})
    assert seen[0] == {"a": ("one", True), "b": ("x", True)}
    assert seen[1] == {"a": ("one", True), "b": ("y", True)}
    assert seen[2]["a"] == ("one", False) and seen[2]["b"] == ("y", True) and seen[2]["c"] == ("z", True)  # 600 s after 0; b was renewed at 400
    assert seen[3]["b"] == ("y", False) and seen[3]["c"] == ("z", True)
