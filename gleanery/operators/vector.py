"""Exact vector search over chunks (entity_id, position, embedding[, embedder, text])."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.vectors import constant, cosine


def scored(chunks: DataFrame, query: list[float], signature: str | None = None, items: list | None = None) -> DataFrame:
    """Chunks with their cosine to the query at six places; only embedded ones, of the given embedder and items. An empty query is like nothing."""
    if not query:
        return chunks.filter(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    own = chunks.filter(F.col("embedding").isNotNull())
    if signature is not None:
        own = own.filter(F.col("embedder") == signature)
    if items is not None:
        own = own.filter(F.col("entity_id").isin(items))
    return own.withColumn("score", F.round(cosine(F.col("embedding"), constant(query)), 6))


def best_chunks(chunks: DataFrame, query: list[float], k: int, signature: str | None = None, items: list | None = None) -> DataFrame:
    """The ``k`` best items by their best chunk: (entity_id, position, score)."""
    nearest = Window.partitionBy("entity_id").orderBy(F.desc("score"), "position")
    first = scored(chunks, query, signature, items).select("entity_id", "position", "score").withColumn("nth", F.row_number().over(nearest)).filter("nth = 1")
    return first.drop("nth").orderBy(F.desc("score"), "entity_id").limit(k)


def top_in_order(chunks: DataFrame, query: list[float], n: int, text: str = "text") -> DataFrame:
    """(entity_id, positions, texts): each item's ``n`` closest chunks in the order of the document."""
    nearest = Window.partitionBy("entity_id").orderBy(F.desc("score"), "position")
    close = scored(chunks, query).withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= n)
    parts = close.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col(text).alias("text")))).alias("p"))
    return parts.select("entity_id", F.col("p.position").alias("positions"), F.col("p.text").alias("texts"))


#: Vectors of a block; a block of chunks meets a block of queries as two matrices.
BLOCK = 1024


def packed(vectors: DataFrame, key: str, ids: str, matrix: str) -> DataFrame:
    """(ids, matrix): vectors (key, embedding) in blocks of at most ``BLOCK``, at unit length; those without a key or a length are left out."""
    own = vectors.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(key, "embedding")

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                m = np.stack(part["embedding"].tolist()).astype("float64")
                norm = np.sqrt((m * m).sum(axis=1))
                kept = norm > 0
                if kept.any():
                    yield pd.DataFrame({ids: [part[key].to_numpy()[kept].tolist()], matrix: [(m[kept] / norm[kept, None]).tobytes()]})

    return own.mapInPandas(run, f"{ids} array<{own.schema[key].dataType.simpleString()}>, {matrix} binary")


def crowding(chunks: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """(entity_id, in_top): how often each item is among the ``n`` best of a query, over all queries (query_id, embedding).

    Items rank by their best chunk, ties by id; those never among the ``n`` best have no row. A task keeps each query's ``n``
    best items of the chunk blocks it saw. That loses nothing: what beats an item there, beats it over all chunks too.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed(chunks, "entity_id", "items", "chunk_matrix").repartition(parts).crossJoin(packed(queries, "query_id", "asked", "query_matrix"))

    def run(frames):
        held = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                q, c = (np.frombuffer(m).reshape(len(ids), -1) for ids, m in ((row.asked, row.query_matrix), (row.items, row.chunk_matrix)))
                items, of = np.unique(row.items, return_inverse=True)
                order = np.argsort(of, kind="stable")
                best = np.maximum.reduceat((q @ c.T)[:, order], np.searchsorted(of[order], np.arange(len(items))), axis=1).round(6)
                top = np.argsort(-best, axis=1, kind="stable")[:, :n]
                new = pd.DataFrame({"query_id": np.repeat(row.asked, top.shape[1]), "entity_id": items[top].ravel(), "score": np.take_along_axis(best, top, 1).ravel()})
                key = row.asked[0]
                both = pd.concat([held[key], new]).groupby(["query_id", "entity_id"], as_index=False)["score"].max() if key in held else new
                held[key] = both.sort_values(["query_id", "score", "entity_id"], ascending=[True, False, True]).groupby("query_id").head(n)
        yield from held.values()

    kinds = (queries.schema["query_id"].dataType.simpleString(), chunks.schema["entity_id"].dataType.simpleString())
    scores = pairs.mapInPandas(run, "query_id {}, entity_id {}, score double".format(*kinds)).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return scores.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= n).groupBy("entity_id").agg(F.count(F.lit(1)).alias("in_top"))


def similar_pairs(counts: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine), a < b, of all items whose term counts (item_id, term, tf) have a cosine of at least ``least`` at six places.

    An item's terms stand in one order for all, the rare ones first. Behind some place the rest of the vector is shorter than ``least``
    and can't reach it, so two similar items share a term before that place in both. Only those meet, and their cosine is taken in full.
    """
    by_item = Window.partitionBy("item_id")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    unit = counts.withColumn("w", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(by_item))).join(df, "term")
    rest = F.sum(F.col("w") * F.col("w")).over(by_item.orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing))
    ahead = unit.withColumn("rest", rest).filter(F.sqrt("rest") >= least - 1e-6).select("item_id", "term")
    x, y = ahead.alias("x"), ahead.alias("y")
    pairs = x.join(y, (F.col("x.term") == F.col("y.term")) & (F.col("x.item_id") < F.col("y.item_id"))).select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).distinct()
    weights = unit.select("item_id", "term", "w")
    both = pairs.join(weights.withColumnsRenamed({"item_id": "a", "w": "wa"}), "a").join(weights.withColumnsRenamed({"item_id": "b", "w": "wb"}), ["b", "term"])
    return both.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine")).filter(F.col("cosine") >= least)


def pending(chunks: DataFrame, signature: str) -> DataFrame:
    """Chunks whose vector is missing or by another embedder."""
    return chunks.filter(F.col("embedding").isNull() | ~F.col("embedder").eqNullSafe(F.lit(signature)))


def embedded(chunks: DataFrame, embed, signature: str, text: str = "text") -> DataFrame:
    """Pending chunks with their new vectors. ``embed`` takes a list of texts and gives as many vectors; another number is an error."""
    own = chunks.select("entity_id", "position", F.col(text).alias("text"))

    def run(frames):
        for frame in frames:
            vectors = embed(frame["text"].tolist())
            if len(vectors) != len(frame):
                raise ValueError(f"{len(vectors)} vectors for {len(frame)} texts")
            yield frame[["entity_id", "position"]].assign(embedding=[[float(x) for x in v] for v in vectors], embedder=signature)

    kind = own.schema["entity_id"].dataType.simpleString()
    return own.mapInPandas(run, f"entity_id {kind}, position {own.schema['position'].dataType.simpleString()}, embedding array<float>, embedder string")


def updated(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks (entity_id, position, ..., embedding, embedder) with the vectors and embedders of ``fresh`` put in; rows of no chunk change nothing."""
    new = fresh.select("entity_id", "position", F.struct("embedding", "embedder").alias("new"))
    held = chunks.join(new, ["entity_id", "position"], "left")
    return held.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in ("embedding", "embedder") else F.col(c) for c in chunks.columns))


def embedder_signature(model: str, prefixes: str, header: str) -> str:
    return f"{model}|{prefixes}|{header}"
