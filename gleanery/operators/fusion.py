"""Reciprocal rank fusion of ranked lists, retrieval, and the context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
#: Fixed values of the rendered context: what each source's items are, and what must be said of them.
KINDS = {
    "obsidian": "NOTE",
    "captures": "CAPTURED IDEA",
    "google_calendar": "CALENDAR EVENT",
    "google_tasks": "OPEN TASK — planned, NOT yet done",
    "github": "REPOSITORY",
}
CAVEATS = {"github": "(repository metadata only — no commit history is indexed)"}


def positioned(hits: DataFrame, *order: Column) -> DataFrame:
    """(entity_id, position) of a short list, from 1. The list has a few dozen rows, as ``limit`` left it."""
    return hits.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("entity_id", "position")


def fused(lists: list[DataFrame], weights: list[float] | None = None, k: int = K) -> DataFrame:
    """(entity_id, score) of all lists (entity_id, position): the sum of weight / (k + position). ``first`` tells where an entity was seen first, for ties."""
    weights = weights or [1.0] * len(lists)
    every = None
    for n, (ranked, w) in enumerate(zip(lists, weights, strict=True)):
        own = ranked.select("entity_id", "position", F.lit(n).alias("list"), (F.lit(float(w)) / (k + F.col("position"))).alias("part"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("entity_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("list", "position")).alias("first"))


def top_fused(lists: list[DataFrame], limit: int, weights: list[float] | None = None, k: int = K) -> DataFrame:
    """The best of the fusion; ties keep the order of the lists."""
    return fused(lists, weights, k).orderBy(F.desc("score"), "first").limit(limit).select("entity_id", "score")


class VectorsUnavailable(Exception):
    """Vector search was asked for and there are no vectors."""


def retrieved(keyword: DataFrame, near: DataFrame | None, mode: str = "hybrid", limit: int = 5) -> DataFrame:
    """(entity_id, score, mode): the best of a keyword list (entity_id, rank) and a vector list (entity_id, score), by one of them or both fused.

    Without vectors (``near`` is None, as when the model is down) a hybrid search answers from keywords and says so in ``mode``; a vector
    search raises ``VectorsUnavailable``. Of equal scores, those of the keyword list come first, in its order.
    """
    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "vector" and near is None:
        raise VectorsUnavailable("a vector search without vectors")
    if mode == "keyword" or near is None:
        return keyword.orderBy(F.desc("rank"), "entity_id").limit(limit).select("entity_id", F.col("rank").alias("score"), F.lit("keyword").alias("mode"))
    if mode == "vector":
        return near.orderBy(F.desc("score"), "entity_id").limit(limit).select("entity_id", "score", F.lit("vector").alias("mode"))
    lists = [positioned(keyword, F.desc("rank"), F.col("entity_id")), positioned(near, F.desc("score"), F.col("entity_id"))]
    return top_fused(lists, limit).select("entity_id", "score", F.lit("hybrid").alias("mode"))


#: Fixed value: how many notes are read whole for one answer.
WHOLE_NOTES = 2


def with_contents(hits: DataFrame, most: int = WHOLE_NOTES) -> DataFrame:
    """Hits (position, is_note, excerpt, body, ...) with ``content``: the body of the first ``most`` notes that have one, else the excerpt."""
    has = F.col("is_note") & (F.coalesce("body", F.lit("")) != "")
    before = F.count_if(has).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))  # a handful of hits
    return hits.withColumn("nth_whole", before).withColumn("content", F.when(has & (F.col("nth_whole") <= most), F.col("body")).otherwise(F.col("excerpt"))).drop("nth_whole")


def rendered(hits: DataFrame) -> DataFrame:
    """One row (context): hits (position, title, source, modified_at, content) as numbered blocks."""
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("source")], F.lit("ITEM"))
    caveat = F.create_map(*(F.lit(x) for kv in CAVEATS.items() for x in kv))[F.col("source")]
    head = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), kind, F.lit(" — "), F.col("title"), F.lit("  (source: "), F.col("source"), F.lit(")"))
    inner = lambda c: F.concat(F.lit("    "), c)
    block = F.concat_ws("\n", head, inner(caveat), inner(F.concat(F.lit("date: "), F.date_format("modified_at", "yyyy-MM-dd HH:mm"))), inner(F.nullif(F.col("content"), F.lit(""))))
    blocks = hits.select(F.struct("position", block.alias("block")).alias("b"))
    found = blocks.agg(F.sort_array(F.collect_list("b")).alias("b"))
    return found.select(F.when(F.size("b") == 0, F.lit("No results found in the user's personal system.")).otherwise(F.array_join(F.col("b.block"), "\n\n")).alias("context"))


def chunk_rendered(path: Column, text: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.lit("["), F.array_join(path, " › "), F.lit("]\n"), text)).otherwise(text)
