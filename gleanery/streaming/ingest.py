"""Continuous ingest: each micro-batch of a source's listing is merged into an index in buckets.

A batch writes the buckets that it touches and a commit that names them; the commit also has the batch's
number, so a batch that is run again after a restart finds that it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.ingest import KEYS, upsert
from gleanery.sources.buckets import BUCKETS, Buckets


def current(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, int]:
    """The index as it is, and the number of its commit; -1 before the first batch."""
    index = Buckets(spark, folder, schema, KEYS)
    at = index.state()
    return index.read(at), at[0]


def index_stream(listing: DataFrame, folder: str, prunes: list[str] = (), buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the merge of a stream of items (see operators.ingest) and stops when all that is there has been read.

    A micro-batch has what came since the last one, so a key that it lacks is no sign of a removal: nothing is pruned unless
    the stream says that a listing is whole. For that it may have a column ``complete``: a provider in ``prunes`` is pruned by
    a batch in which all its rows have ``complete`` true, to the keys of those rows. Of rows with one key the newest stays:
    by ``modified_at``, a missing time first, then by fingerprint. A stream of changes may have a column ``deleted``: keys of such rows leave the
    index, unless the batch has a row for the key that isn't deleted.
    """
    whole, removes = "complete" in listing.columns, "deleted" in listing.columns
    schema = listing.drop("complete", "deleted").schema
    newest = F.max_by(F.struct(*schema.names), F.struct(F.coalesce(F.col("modified_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col("fingerprint")))

    def step(batch: DataFrame, number: int) -> None:
        index = Buckets(batch.sparkSession, folder, schema, KEYS, buckets)
        if index.state()[1].get("marks", {}).get("batch", -1) >= number:
            return  # run before, and done
        there = batch.filter(~F.coalesce("deleted", F.lit(False))) if removes else batch
        new = there.groupBy(*KEYS).agg(newest.alias("r")).select("r.*")
        gone = batch.filter("deleted").select(*KEYS).distinct() if removes else None
        complete = [r["provider"] for r in batch.filter(F.col("provider").isin(list(prunes))).groupBy("provider").agg(F.min(F.coalesce("complete", F.lit(False))).alias("all")).filter("all").collect()] if whole and prunes else []
        upsert(index, new, complete, {"batch": number}, gone)

    return listing.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(step).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream (ts, event_type, value) by tumbling windows; events later than the watermark drop out.

    A time without a zone is taken as UTC, since watermarks need an instant.
    """
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
