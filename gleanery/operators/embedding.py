"""Vectors of texts from a model behind requests, and the upkeep of a table of chunks whose vectors are pending.

Requests hold a fixed number of texts, and a fixed number of them are in flight in a task at a time; results come
back in the order of the texts whatever order they arrive in. Pending chunks are laid out as files by the
bucket of the chunk table that they belong to and read as a stream of a few files at a time. Each
batch is embedded and committed before the next, so a failure keeps what was done; the next run takes up
what is still pending. As a batch holds a few buckets, the table is written about once in all.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.vector import pending
from gleanery.sources.buckets import Buckets
from gleanery.sources.commits import Conflict
from gleanery.sources.shared import written

#: Texts of a request, and what stands before a text that is stored and before a question.
REQUEST_TEXTS = 32
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
IN_FLIGHT = 4

Embed = Callable[[list[str]], list[list[float]]]
CHUNK = "entity_id long, position int, text string, embedding array<float>, embedder string"
KEYS = ["entity_id", "position"]


class EmbeddingsUnavailable(RuntimeError):
    """The model can't be reached, or its answer can't be used. Searches fall back to keywords then."""


def in_order(texts: Iterator[list[str]], embed: Embed, in_flight: int = IN_FLIGHT) -> Iterator[list[list[float]]]:
    """The vectors of each list of texts, in order, with at most ``in_flight`` requests under way."""

    def request(own: list[str]) -> list[list[float]]:
        vectors = embed(own)
        if len(vectors) != len(own):
            raise EmbeddingsUnavailable(f"{len(vectors)} vectors for {len(own)} texts")
        return vectors

    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        try:
            for own in texts:
                if len(waiting) == in_flight:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(request, own))
            while waiting:
                yield waiting.popleft().result()
        finally:
            for f in waiting:
                f.cancel()


def embedded(rows: DataFrame, embed: Embed, text: str = "text", prefix: str = DOCUMENT_PREFIX, size: int = REQUEST_TEXTS, in_flight: int = IN_FLIGHT) -> DataFrame:
    """The rows with the vectors of their texts in ``vector``; a null text is embedded as the prefix alone."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[pa.RecordBatch] = deque()

        def requests() -> Iterator[list[str]]:
            for batch in batches:
                for k in range(0, batch.num_rows, size):
                    part = batch.slice(k, size)
                    held.append(part)
                    yield [prefix + (t or "") for t in part.column(at).to_pylist()]

        for vectors in in_order(requests(), embed, in_flight):
            part = held.popleft()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, "vector"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vector array<float>")


def query_vector(embed: Embed, text: str) -> list[float]:
    """The vector of one question."""
    return next(in_order(iter([[QUERY_PREFIX + text]]), embed))[0]


def embed_pending(chunks: Buckets, embed: Embed, signature: str, files: int = 4, rows_a_file: int = 50_000, in_flight: int = IN_FLIGHT) -> int:
    """Gives every chunk (entity_id, position, text, embedding, embedder) of the table that lacks a vector by this signature one; the number of chunks that were embedded.

    ``files`` are the files of a batch, of ``rows_a_file`` rows at most. A chunk whose text has changed since it was read keeps waiting.
    """
    spark = chunks.spark
    run = uuid.uuid4().hex
    folder = f"{chunks.folder.path}/pending-{run}"
    todo = pending(chunks.read(), signature).select(*KEYS, "text")
    todo.withColumn("bucket", chunks.bucket()).hint("rebalance", "bucket").write.option("maxRecordsPerFile", rows_a_file).partitionBy("bucket").parquet(folder)
    if not any(n.startswith("bucket=") for n in chunks.folder.names(f"pending-{run}")):
        return 0
    done = 0

    def step(batch: DataFrame, number: int) -> None:
        nonlocal done
        marks = chunks.state()[1].get("marks", {})
        if marks.get("run") == run and marks["batch"] >= number:
            return  # committed before the stream could note it
        fresh = written(embedded(batch.select(*KEYS, "text"), embed, in_flight=in_flight), f"{chunks.folder.path}/vectors")
        touched = chunks.buckets_of(fresh)
        new = fresh.select(*KEYS, F.col("text").alias("of"), F.col("vector").alias("new"))
        while True:
            at = chunks.state()
            held = chunks.read(at, touched).join(new, KEYS, "left")
            hit = F.col("new").isNotNull() & F.col("of").eqNullSafe(F.col("text"))
            rows = held.withColumns({"embedding": F.when(hit, F.col("new")).otherwise(F.col("embedding")), "embedder": F.when(hit, F.lit(signature)).otherwise(F.col("embedder"))}).select(*chunks.schema.names)
            try:
                chunks.write(at, rows, touched, marks={"run": run, "batch": number})
                break
            except Conflict:
                continue  # the vectors are there; only the commit is tried again
        done += fresh.count()

    stream = spark.readStream.schema(f"{todo.schema.simpleString()[7:-1].replace(':', ' ')}, bucket int").option("maxFilesPerTrigger", files).parquet(folder)
    query = stream.writeStream.option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return done
