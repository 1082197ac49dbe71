"""Tags of notes: counts, likeness and suggestions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleanery.functions.text import tag_normalised
from gleanery.functions.vectors import cosine

# What a note is, and from which score on tags are alike by meaning, fit a note, or are alike by spelling.
TYPE_TAGS = ("project", "adr", "plan", "learning", "note")
SAME_MEANING, FITS_NOTE, SAME_SPELLING = 0.68, 0.60, 0.85
MAX_TOPICS = 3


def histogram(notes: DataFrame) -> DataFrame:
    """(tag, notes) over notes (tags); two spellings of one tag in one note count twice."""
    own = notes.select(F.explode("tags").alias("raw")).select(tag_normalised(F.col("raw")).alias("tag"))
    return own.filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))


@F.pandas_udf(DoubleType())
def spelling(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching runs (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def letters_shared(a: Column, b: Column) -> Column:
    """Twice the number of characters that both have, counted with repetition, over both lengths: at least the spelling ratio."""
    counts = lambda c: F.transform(F.array_distinct(F.split(c, "")), lambda x: F.struct(x.alias("x"), (F.length(c) - F.length(F.replace(c, x))).alias("n")))
    both = F.transform(counts(a), lambda s: F.least(s["n"], F.length(b) - F.length(F.replace(b, s["x"]))))
    return 2 * F.aggregate(both, F.lit(0), lambda t, n: t + n) / (F.length(a) + F.length(b))


def alike_by_spelling(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(tag, similar, score): for wanted (tag) the best known (similar, nth) of at least 0.85, the first of equals. ``known`` is the vault's tags, some hundreds.

    Lengths and shared characters bound the ratio from above, so the ratio itself is taken only of pairs that can reach it.
    """
    pairs = wanted.join(known.filter(~F.col("similar").isin(*TYPE_TAGS)), (F.col("tag") != F.col("similar")) & (2 * F.least(F.length("tag"), F.length("similar")) >= SAME_SPELLING * (F.length("tag") + F.length("similar"))))
    scored = pairs.filter(letters_shared(F.col("tag"), F.col("similar")) >= SAME_SPELLING).withColumn("score", spelling("tag", "similar"))
    best = Window.partitionBy("tag").orderBy(F.desc("score"), "nth")
    return scored.filter(F.col("score") >= SAME_SPELLING).withColumn("n", F.row_number().over(best)).filter("n = 1").select("tag", "similar", F.round("score", 3).alias("score"))


def alike_by_meaning(wanted: DataFrame, known: DataFrame, least: float = SAME_MEANING) -> DataFrame:
    """(tag, similar, score): for wanted (tag, vector) the best known (similar, known_vector); of equal scores the largest tag."""
    pairs = wanted.join(known, F.col("tag") != F.col("similar")).withColumn("score", F.round(cosine(F.col("vector"), F.col("known_vector")), 6))
    return pairs.groupBy("tag").agg(F.max(F.struct("score", "similar")).alias("b")).filter(F.col("b.score") >= least).select("tag", "b.similar", "b.score")


def similar_existing(wanted: DataFrame, known: DataFrame, model: bool = True) -> DataFrame:
    """(tag, similar, score, by, checked_meaning) of every wanted (tag, vector): the known (similar, nth, known_vector) closest by spelling if that is close enough, else by meaning.

    Without the ``model`` only spelling is compared; ``checked_meaning`` says so where that found nothing, unless there is nothing to compare with.
    Tags that say what a note is are no candidates.
    """
    known = known.filter(~F.col("similar").isin(*TYPE_TAGS))
    others = known.groupBy().agg(F.count(F.lit(1)).alias("n_known"), F.collect_set("similar").alias("known_tags"))  # one row, of a vault's tags
    spelled = alike_by_spelling(wanted.select("tag"), known.select("similar", "nth")).select("tag", F.col("similar").alias("s1"), F.col("score").alias("v1"))
    found = wanted.select("tag").distinct().join(spelled, "tag", "left").crossJoin(others)
    alone = F.col("n_known") - F.array_contains("known_tags", F.col("tag")).cast("int") == 0
    if model:
        meant = alike_by_meaning(wanted, known.select("similar", "known_vector")).select("tag", F.col("similar").alias("s2"), F.col("score").alias("v2"))
        found = found.join(meant, "tag", "left")
    else:
        found = found.withColumns({"s2": F.lit(None).cast("string"), "v2": F.lit(None).cast("double")})
    by = F.when(F.col("s1").isNotNull(), "spelling").when(F.col("s2").isNotNull(), "meaning")
    return found.select("tag", F.coalesce("s1", "s2").alias("similar"), F.round(F.coalesce("v1", "v2"), 2).alias("score"), by.alias("by"), (F.lit(model) | F.col("s1").isNotNull() | alone).alias("checked_meaning"))


def suggested(notes: DataFrame, known: DataFrame, most: int = MAX_TOPICS) -> DataFrame:
    """(note_id, tag, score): for notes (note_id, vector) the best known tags (similar, known_vector) of at least 0.60."""
    pairs = notes.crossJoin(known.filter(~F.col("similar").isin(*TYPE_TAGS))).withColumn("score", F.round(cosine(F.col("vector"), F.col("known_vector")), 6))
    best = Window.partitionBy("note_id").orderBy(F.desc("score"), F.desc("similar"))
    return pairs.withColumn("n", F.row_number().over(best)).filter((F.col("n") <= most) & (F.col("score") >= FITS_NOTE)).select("note_id", F.col("similar").alias("tag"), "score")


def words_fit(notes: DataFrame, known: DataFrame) -> DataFrame:
    """(note_id, tag): tags all of whose parts are words of the note; for notes (note_id, text) and tags (tag).

    Each note's distinct words meet the tags' parts by the word, and a tag fits where as many parts were met as it has.
    """
    parts = known.filter(~F.col("tag").isin(*TYPE_TAGS)).select("tag", F.array_distinct(F.filter(F.split("tag", "-"), lambda p: p != "")).alias("parts")).distinct()
    by_word = parts.select("tag", F.size("parts").alias("n"), F.explode("parts").alias("word"))
    words = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("word"))
    met = words.join(by_word, "word").groupBy("note_id", "tag").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    bare = notes.select("note_id").crossJoin(parts.filter(F.size("parts") == 0).select("tag"))  # a tag of no parts fits every note
    return met.filter("met = n").select("note_id", "tag").unionByName(bare)
