"""Small questions to a model, each asked once: a store of answers by content, and a budget of tokens.

A question's key is the digest of the version, the backend, the options and the prompt, so whatever would change the
answer changes the key. The store only grows: a run adds the answers that it was given as files of their own and commits
them. Questions whose key is in the store are answered from there. For that, the store's keys are first held against
a Bloom filter of the questions' keys, so the part that is joined is as large as the batch, however long the store is.
Of equal questions one is put to the backend.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.bloom import bloom, fits, perhaps_in
from gleanery.functions.totals import totals_before
from gleanery.sources.commits import Commits
from gleanery.sources.shared import written

STORED = "key string, answer string, confidence double"

#: Answers (key, answer, confidence) to questions (key, prompt, options).
Backend = Callable[[DataFrame], DataFrame]


def check_key(version: str, backend: str, options: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(version), F.lit(backend), F.to_json(options), prompt), 256)


class Store:
    """Answers under a folder, as commits list them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.commits = spark, Commits(spark, folder)
        self.folder = self.commits.folder.path

    def read(self) -> DataFrame:
        parts = self.commits.latest()[1].get("parts", [])
        return self.spark.read.schema(STORED).parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], STORED)

    def add(self, answers: DataFrame) -> None:
        """Writers don't exclude each other: if two were given an answer to one question, the first by answer is read."""
        name = f"answers-{uuid.uuid4().hex}"
        answers.select("key", "answer", F.col("confidence").cast("double").alias("confidence")).write.parquet(f"{self.folder}/{name}")
        self.commits.commit(self.commits.latest(), lambda entry: {"parts": [*entry.get("parts", []), name]})

    def known(self, keys: DataFrame) -> DataFrame:
        """(key, answer, confidence), once for each of the keys (key), which are distinct, that is in the store."""
        n, held = keys.count(), self.read()
        if fits(n):
            held = perhaps_in(held, "key", bloom(keys, "key", n), n)
        return held.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("answer", "confidence")).alias("a")).select("key", "a.*")


def asked(store: Store, questions: DataFrame, backend: Backend, name: str, version: str, order: Sequence[str], budget: int | None = None) -> DataFrame:
    """Questions (prompt, options, cost, ...) with key, answer, confidence and ``outcome``: cached, called, shared (one equal to a question that was called), or over budget.

    ``cost`` is the number of tokens that a call takes. Calls are made in the order of ``order``, which must be total, until their tokens reach the budget: a call is made
    if those before it took less than the budget. Answers are in the store before this returns, so a run that is repeated calls nothing again.
    """
    folder = f"{store.folder}/runs"
    own = written(questions.withColumn("key", check_key(version, name, F.col("options"), F.col("prompt"))), folder)
    first = own.groupBy("key").agg(F.min(F.struct(*order)).alias("o"))
    known = written(store.known(first.select("key")), folder)
    missing = first.join(known, "key", "left_anti").join(own, "key").filter(F.struct(*order).eqNullSafe(F.col("o")))
    missing = totals_before(missing.select("key", "prompt", "options", "cost", *order), list(order), "cost", folder)
    called = missing if budget is None else missing.filter(F.col("before") < budget)
    answers = written(backend(called.select("key", "prompt", "options")), folder)
    store.add(answers)
    told = known.withColumn("cached", F.lit(True)).unionByName(answers.select("key", "answer", F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("cached")))
    found = own.join(told, "key", "left").join(first, "key")
    mine = F.struct(*order).eqNullSafe(F.col("o"))
    outcome = F.when(F.col("cached").isNull(), "over budget").when(F.col("cached"), "cached").when(mine, "called").otherwise("shared")
    return found.withColumn("outcome", outcome).drop("cached", "o")


class AnswersUnavailable(RuntimeError):
    """The backend gave other than one of the options for each question."""


def by_request(ask: Callable[[str, list[str]], tuple[str, float | None]]) -> Backend:
    """A backend that puts one question at a time to ``ask``, in the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt, options in zip(frame["key"], frame["prompt"], frame["options"], strict=True):
                answer, confidence = ask(prompt, list(options))
                if answer not in options:
                    raise AnswersUnavailable(f"{answer!r} is none of {list(options)}")
                rows.append((key, answer, confidence))
            yield pd.DataFrame(rows, columns=["key", "answer", "confidence"])

    return lambda questions: questions.mapInPandas(run, STORED)
