"""Keyword search over postings.

A posting is (entity_id, lexeme, pos, weight): weight A for titles and tags, B for the
body. Stored postings are gathered into lists (lexeme, weight, entity_ids, positions). A search reads only the postings of its own lexemes, gathers them once by entity
with sums made before the shuffle, and ranks: for each query lexeme tf / (tf + 1), where
tf sums 1.0 for A and 0.4 for B, averaged over the lexemes. Ranks are comparable within
one query only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import words as W
from gleanery.functions.batches import map_runs

WORD = "[a-z0-9]+"
WEIGHTS = {"A": 1.0, "B": 0.4}
#: Bytes of texts or of postings that are gathered into lists at a time.
RUN_BYTES = 16 << 20


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def postings(items: DataFrame, stop: list[str], stem: DataFrame | Callable[[Column], Column] | None = None) -> DataFrame:
    """(entity_id, lexeme, pos, weight) of items (entity_id, title, body). ``stem`` maps (word, lexeme), where words that it lacks stay, or makes lexemes of an array of words, which sends no posting anywhere.

    Positions run on from the title to the body and count stop words.
    """
    title, body = (lexemes(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body"))
    words = F.concat(title, body)
    if callable(stem):
        words = stem(F.transform(words, lambda w: F.when(~w.isin(stop), w)) if stop else words)
    out = items.select("entity_id", F.size(title).alias("before"), words.alias("words")).select("entity_id", "before", F.posexplode_outer("words").alias("pos", "lexeme"))  # without outer, a filter cuts all words once more where the texts are read
    out = out.select("entity_id", "lexeme", F.col("pos").cast("int").alias("pos"), F.when(F.col("pos") < F.col("before"), "A").otherwise("B").alias("weight"))
    out = out.filter("lexeme IS NOT NULL")
    if callable(stem):
        return out
    out = out.filter(~F.col("lexeme").isin(stop)) if stop else out
    if stem is not None:
        known = stem.select(F.col("word").alias("lexeme"), F.col("lexeme").alias("stemmed"))
        out = out.join(known, "lexeme", "left").select("entity_id", F.coalesce("stemmed", "lexeme").alias("lexeme"), "pos", "weight")
    return out


def lists(items: DataFrame, stop: list[str], stem: Callable[[str], str] | None = None) -> DataFrame:
    """The postings of items (entity_id, title, body), gathered by lexeme and weight over ``RUN_BYTES`` of texts at a time; each run is in the order of its lexemes."""
    stopped = pa.array(stop, pa.string())

    def run(batch: pa.RecordBatch):
        ids, title, body = batch.columns
        (heads, before), (rest, after) = W.words(title), W.words(body)
        coded = pa.concat_arrays([heads, rest]).dictionary_encode()
        made = pc.if_else(pc.is_in(coded.dictionary, stopped), pa.scalar(None, pa.string()), coded.dictionary)
        made = pa.array([w and stem(w) for w in made.to_pylist()], pa.string()) if stem else made
        lexeme, names = W.ranked(made.dictionary_encode())
        (owner, pos), (owner2, pos2) = W.places(before), W.places(after, before)
        weight = np.repeat([0, 1], [len(heads), len(rest)])
        return W.lists((lexeme[coded.indices.to_numpy()], names), (weight, pa.array(["A", "B"])), ids, np.concatenate([owner, owner2]), np.concatenate([pos, pos2]))

    own = items.select("entity_id", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("title", "body")))
    return map_runs(own, run, _lists_schema(own), RUN_BYTES)


def gathered(postings: DataFrame) -> DataFrame:
    """Postings as lists, gathered as they come, ``RUN_BYTES`` at a time."""

    def run(batch: pa.RecordBatch):
        ids, lexeme, pos, weight = batch.columns
        return W.lists(W.ranked(pc.dictionary_encode(lexeme)), W.ranked(pc.dictionary_encode(weight)), ids, np.arange(len(ids)), pos.to_numpy())

    own = postings.select("entity_id", "lexeme", "pos", "weight")
    return map_runs(own, run, _lists_schema(own), RUN_BYTES)


def _lists_schema(own: DataFrame) -> str:
    return lists_schema(own.schema["entity_id"].dataType.simpleString())


def lists_schema(kind: str) -> str:
    return f"lexeme string, weight string, entity_ids array<{kind}>, positions array<int>"


def spread(lists: DataFrame) -> DataFrame:
    """The postings of lists. No list is empty; without outer, a filter that asks so would be added to what a scan reads."""
    each = lists.select("*", F.posexplode_outer("entity_ids").alias("at", "entity_id"))
    kept = [c for c in lists.columns if c not in ("lexeme", "weight", "entity_ids", "positions")]
    return each.select("entity_id", "lexeme", F.get("positions", "at").alias("pos"), "weight", *kept)


@dataclass
class Term:
    """One word or phrase of a query."""

    words: list[str]
    negated: bool = False


@dataclass
class Query:
    """Alternatives, each of terms that must all hold; and the prefix of the last word."""

    alternatives: list[list[Term]] = field(default_factory=list)
    prefix: str = ""

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(w for group in self.alternatives for t in group for w in t.words))

    @property
    def wanted(self) -> list[str]:
        return list(dict.fromkeys(w for group in self.alternatives for t in group if not t.negated for w in t.words))


def parse(text: str, stop: list[str], stem: Callable[[str], str] = str) -> Query:
    """Words, "phrases", OR and -exclusions; stop words drop out, and so do terms of nothing else. ``stem`` makes the index's lexeme of a word."""
    groups: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text):
        if m[3] == "OR":
            groups.append([])
            continue
        negated = m[1] == "-" if m[3] is None else m[3].startswith("-")
        words = [stem(w) for w in re.findall(WORD, (m[2] if m[3] is None else m[3]).lower()) if w not in stop]
        if words:
            groups[-1].append(Term(words, negated))
    prefix = prefix_of(text, stop)
    return Query([g for g in groups if g], stem(prefix) if prefix else "")


def prefix_of(text: str, stop: list[str]) -> str:
    last = (text.split() or [""])[-1]
    prefix = "".join(c for c in last if c.isalnum() or c == "_").lower()
    return "" if prefix in stop else prefix


def _stands(words: list[str], counts: dict[str, Column], places: dict[str, Column]) -> Column:
    """True where a word is there, or the words of a phrase stand in a row."""
    if len(words) == 1:
        return counts[words[0]] > 0
    return F.exists(places[words[0]], lambda p: reduce(lambda a, b: a & b, (F.array_contains(places[w], (p + k).cast("int")) for k, w in enumerate(words[1:], 1))))


def _saturated(tf: Column) -> Column:
    return tf / (tf + F.lit(1.0))


def search(index: DataFrame, text: str, stop: list[str], mode: str = "all", strict: bool = False, items: DataFrame | None = None, stem: Callable[[str], str] = str) -> DataFrame:
    """(entity_id, rank) of matching entities.

    ``any``: any word matches. ``all``: the query as written, or the prefix of its last word unless ``strict``.
    ``prefix``: that prefix alone. A query of nothing but stop words matches nothing. ``items`` (entity_id) is
    needed only where an alternative has exclusions alone.
    """
    query = parse(text, stop, stem)
    if mode == "any":
        query = Query([[Term([w])] for w in query.wanted])
    elif mode == "prefix":
        query = Query([], query.prefix)
    prefix = query.prefix if mode != "any" and not strict else ""
    words = query.words
    if not words and not prefix:
        return index.select("entity_id", F.lit(0.0).alias("rank")).limit(0)
    weight = F.when(F.col("weight") == "A", WEIGHTS["A"]).otherwise(WEIGHTS["B"])
    needed = F.col("lexeme").isin(words)
    aggs = []
    phrases = {w for group in query.alternatives for t in group if len(t.words) > 1 for w in t.words}
    for k, w in enumerate(words):
        own = F.col("lexeme") == w
        aggs.append(F.sum(F.when(own, weight).otherwise(0.0)).alias(f"tf{k}"))
        if w in phrases:  # the others are sums alone, which shrink before the shuffle
            aggs.append(F.collect_list(F.when(own, F.col("pos"))).alias(f"at{k}"))
    if prefix:
        begins = F.col("lexeme").startswith(prefix)
        needed = needed | begins
        aggs.append(F.sum(F.when(begins, weight).otherwise(0.0)).alias("tfp"))
    found = index.filter(needed).groupBy("entity_id").agg(*aggs)
    if items is not None and any(all(t.negated for t in g) for g in query.alternatives):
        found = items.select("entity_id").join(found, "entity_id", "left")
        found = found.select("entity_id", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c.startswith("tf") else F.coalesce(F.col(c), F.array().cast("array<int>")).alias(c) for c in found.columns[1:]))
    places = {w: F.col(f"at{k}") for k, w in enumerate(words) if w in phrases}
    counts = {w: F.col(f"tf{k}") for k, w in enumerate(words)}
    holds = F.lit(False)
    for group in query.alternatives:
        holds = holds | reduce(lambda a, b: a & b, ((~_stands(t.words, counts, places)) if t.negated else _stands(t.words, counts, places) for t in group))
    ranked = [words.index(w) for w in query.wanted]
    by_words = reduce(lambda a, b: a + b, (_saturated(F.col(f"tf{k}")) for k in ranked), F.lit(0.0)) / max(1, len(ranked))
    by_prefix = _saturated(F.col("tfp")) if prefix else F.lit(0.0)
    matches = holds | (F.col("tfp") > 0) if prefix else holds
    return found.filter(matches).select("entity_id", F.greatest(F.when(holds, by_words).otherwise(0.0) if not prefix else by_words, by_prefix).alias("rank"))


def top(hits: DataFrame, k: int, *then: Column) -> DataFrame:
    """The best ``k``; ranks compare at six places, and the id makes the order total."""
    return hits.withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), *then, "entity_id").limit(k)


def length_normalised(rank: Column, length: Column, flag: int) -> Column:
    """Flags as full-text search engines have them: 0 none, 1 by 1 + log of the length, 2 by the length, 32 to below 1."""
    if flag == 1:
        return rank / (1 + F.log(length.cast("double")))
    if flag == 2:
        return rank / length
    return rank / (rank + 1) if flag == 32 else rank
