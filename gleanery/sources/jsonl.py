"""Data sets as folders of JSON lines, and records of runs that only ever grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.sources.commits import Commits, Conflict


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file or folder of JSON lines; a line that isn't JSON ends the job, a field that is missing is null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows as lines; those that are there stay as they are."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def versions(spark: SparkSession, folder: str) -> int:
    """The number of the current version; -1 if there is none."""
    return Commits(spark, folder).latest()[0]


def rewritten(rows: DataFrame, folder: str, onto: int | None = None) -> int:
    """Writes the whole data set anew beside the old one, then commits it: readers see the old one or the new one, never a part.

    ``onto`` is the version that the rows were made from, the current one if not given. If another writer has committed
    since, ``Conflict`` is raised and the other's version stays.
    """
    commits = Commits(rows.sparkSession, folder)
    version = commits.latest()[0] if onto is None else onto
    name = f"data-{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(f"{folder}/{name}")
    if not commits.put(version + 1, {"data": name}):
        raise Conflict(f"version {version + 1} is another writer's")
    return version + 1


def current(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    version, entry = Commits(spark, folder).latest()
    return spark.createDataFrame([], schema) if version < 0 else scan(spark, f"{folder}/{entry['data']}", schema)


def record_run(run: DataFrame, folder: str) -> None:
    """Appends one run (name, date, ...) to the record of runs; a name that is there already is refused, as the runs are compared by name."""
    spark = run.sparkSession
    try:
        known = spark.read.json(folder).select("name")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None and not known.join(run.select("name"), "name", "left_semi").isEmpty():
        raise ValueError("a run of that name is recorded already")
    append(run, folder)
