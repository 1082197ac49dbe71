"""Remote listings that come page by page, as partitioned reads.

A collection (a calendar, a task list, a list of repositories) is a partition; a task
follows its pages. How a page is fetched is a function that the caller gives.
"""

from __future__ import annotations

import random
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed values of the retry rule.
ATTEMPTS, LONGEST_WAIT = 4, 30.0


@dataclass
class Page:
    """A response: status, rows, the token of the next page, headers."""

    status: int
    rows: list[dict] = field(default_factory=list)
    next_token: str | None = None
    headers: dict[str, str] = field(default_factory=dict)


class Unavailable(RuntimeError):
    pass


def fetched(fetch: Callable[[str | None], Page], token: str | None, refresh: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> Page:
    """A page, tried again: once after a refresh if access ended (401), with growing pauses if the other side is busy (429, 5xx), never if it is forbidden (403)."""
    refreshed = False
    for attempt in range(ATTEMPTS):
        page = fetch(token)
        if page.status < 400:
            return page
        if page.status == 401 and refresh is not None and not refreshed:
            refresh()
            refreshed = True
        elif page.status == 429 or page.status >= 500:
            asked = page.headers.get("Retry-After", "")
            sleep(min(LONGEST_WAIT, float(asked) if asked.isdigit() else 2**attempt + random.random()))
        else:
            break
    raise Unavailable(f"status {page.status}")


def by_token(fetch: Callable[[str | None], Page], limit: int | None = None, **how) -> Iterator[dict]:
    """Rows of all pages, until there is no next token or the limit is reached."""
    token, given = None, 0
    while True:
        page = fetched(fetch, token, **how)
        for row in page.rows:
            if limit is not None and given >= limit:
                return
            given += 1
            yield row
        token = page.next_token
        if not token:
            return


def next_link(header: str) -> str | None:
    """The address marked as next in a Link header."""
    return next((m[1] for m in re.finditer(r'<([^>]*)>\s*;[^,]*\brel="next"', header)), None)


def by_link(fetch: Callable[[str | None], Page], limit: int | None = None, **how) -> Iterator[dict]:
    """As by_token, with the next address taken from the Link header."""

    def own(token: str | None) -> Page:
        page = fetch(token)
        page.next_token = next_link(page.headers.get("Link", ""))
        return page

    return by_token(own, limit, **how)


def pages_by_token(fetch: Callable[[str | None], Page], limit: int | None = None, **how) -> Iterator[list[dict]]:
    """The rows of one page after the other, until there is no next token or the limit is reached."""
    token, given = None, 0
    while limit is None or given < limit:
        page = fetched(fetch, token, **how)
        rows = page.rows if limit is None else page.rows[: limit - given]
        given += len(rows)
        yield rows
        token = page.next_token
        if not token:
            return


class Collection(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class Collections(DataSourceReader):
    def __init__(self, names: list[str], pages: Callable[[str], Iterator[list[dict]]], schema: StructType) -> None:
        self.names, self.pages, self.kind = names, pages, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return [Collection(n) for n in self.names]

    def read(self, partition: Collection) -> Iterator[pa.RecordBatch]:
        for rows in self.pages(partition.name):
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in self.kind.names} for r in rows], schema=self.kind)


def streamed(spark: SparkSession, collections: list[str], pages: Callable[[str], Iterator[list[dict]]], schema: str) -> DataFrame:
    """Rows of every collection, a partition each, page by page: a task holds one page. ``pages`` gives the pages of a collection, as dicts with the schema's fields.

    The first failure that isn't mended by trying again ends the read, after Spark's own attempts at the task.
    """
    kind = spark.createDataFrame([], schema).schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"pages_{uuid.uuid5(uuid.NAMESPACE_OID, schema).hex}"

        def schema(self) -> StructType:
            return kind

        def reader(self, schema: StructType) -> DataSourceReader:
            return Collections(collections, pages, kind)

    spark.dataSource.register(Source)
    return spark.read.format(Source.name()).load() if collections else spark.createDataFrame([], schema)


def listed(spark: SparkSession, collections: list[str], rows: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of every collection, one task each; a collection that fails fails the read. ``rows`` gives dicts with the schema's fields."""
    own = spark.createDataFrame([(c,) for c in collections], "collection string").repartition(max(1, len(collections)), "collection")
    names = [f.split()[0].strip("` ") for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for collection in frame["collection"]:
                found = [[r.get(n) for n in names] for r in rows(collection)]
                if found:
                    yield pd.DataFrame(found, columns=names, dtype=object)

    return own.mapInPandas(run, schema)
