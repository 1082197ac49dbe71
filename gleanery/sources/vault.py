"""A folder of Markdown notes as a Spark data source.

Unlike Spark's own readers it lists files whose names begin with ``_``, files in hidden
folders (but for the vault's own two) and empty files. The driver lists paths only;
tasks read bodies, of the notes and where they are asked for. A path that leads out of the
vault through links is refused. As a stream, the source gives what changed since its last listing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleanery.functions.batches import map_slices
from gleanery.functions.heads import head_and_body, head_tags
from gleanery.functions.text import inline_tags

SKIPPED = {".obsidian", ".trash"}
SCHEMA = "path string, modified_at timestamp, content binary"


def contained(root: Path, name: str) -> Path | None:
    """The file of that name, or None if it lies outside of the vault once links and dots are resolved."""
    base = root.resolve()
    path = (base / name).resolve()
    return path if path.is_relative_to(base) else None


class Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def listing(root: str) -> dict[str, int]:
    """The time in nanoseconds at which each note of the vault was last written, by path; no body is read."""
    base = Path(root)
    found = {}
    for p in base.rglob("*.md"):
        name = str(p.relative_to(base))
        if p.is_file() and not SKIPPED & set(p.relative_to(base).parts) and contained(base, name):
            found[name] = p.stat().st_mtime_ns
    return found


def read_file(root: str, name: str, bodies: bool = True) -> tuple | None:
    """A note's row (path, modified_at, content), or None if there is none of that name inside the vault. Tests count the calls that open a file."""
    path = contained(Path(root), name)
    if path is None or not path.is_file() or SKIPPED & set(Path(name).parts) or path.suffix != ".md":
        return None
    return name, datetime.fromtimestamp(path.stat().st_mtime, timezone.utc), opened(path) if bodies else None


def opened(path: Path) -> bytes:
    return path.read_bytes()


class VaultReader(DataSourceReader):
    def __init__(self, root: str, limit: int | None, files_a_task: int, bodies: bool, only: list[str] | None) -> None:
        self.root, self.limit, self.files_a_task, self.bodies, self.only = root, limit, files_a_task, bodies, only

    def partitions(self) -> list[InputPartition]:
        if self.only is not None:
            names = sorted(set(self.only))
        else:
            found = listing(self.root)
            # the limit comes before any body is read: newest first
            names = sorted(found, key=lambda n: (-found[n], n))[: self.limit]
        return [Files(names[k : k + self.files_a_task]) for k in range(0, len(names), self.files_a_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            if (row := read_file(self.root, name, self.bodies)) is not None:
                yield row


class FilteredVaultReader(VaultReader):
    """As Spark allows where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A filter on the path names the files, so no other is listed or opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",) and self.limit is None:
                names = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.only = names if self.only is None else [n for n in self.only if n in names]
            else:
                yield f


class Changes(InputPartition):
    def __init__(self, names: list[str], gone: list[str]) -> None:
        self.names, self.gone = names, gone


class VaultChanges(DataSourceStreamReader):
    """What was written or removed between two listings. An offset is a listing, path to time, so it is as long as the vault has notes."""

    def __init__(self, root: str, files_a_task: int) -> None:
        self.root, self.files_a_task = root, files_a_task

    def initialOffset(self) -> dict:
        return {"notes": {}}

    def latestOffset(self) -> dict:
        return {"notes": listing(self.root)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = start["notes"], end["notes"]
        changed = sorted(n for n, t in after.items() if before.get(n) != t)
        gone = sorted(n for n in before if n not in after)
        return [Changes(changed[k : k + self.files_a_task], []) for k in range(0, len(changed), self.files_a_task)] + ([Changes([], gone)] if gone else [])

    def read(self, partition: Changes) -> Iterator[tuple]:
        for name in partition.names:
            if (row := read_file(self.root, name)) is not None:  # one that has gone since is in the next listing's removals
                yield *row, False
        for name in partition.gone:
            yield name, None, None, True

    def commit(self, end: dict) -> None:
        pass


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        limit, only = self.options.get("limit"), self.options.get("only")
        kind = FilteredVaultReader if self.options.get("filters") == "true" else VaultReader
        return kind(self.options["path"], None if limit is None else int(limit), int(self.options.get("filesATask", "200")), self.options.get("bodies", "true") == "true", None if only is None else [only])


class VaultChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return f"{SCHEMA}, deleted boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VaultChanges(self.options["path"], int(self.options.get("filesATask", "200")))


def _with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def read_vault(spark: SparkSession, root: str, limit: int | None = None, **options: str) -> DataFrame:
    """(path, modified_at, content, text): bytes that aren't UTF-8 become replacement characters in ``text``; ``content`` is exact."""
    spark.dataSource.register(VaultSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("vault").option("path", root).option("filters", filters).options(**options)
    return _with_text((reader if limit is None else reader.option("limit", str(limit))).load())


def listed(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(path, modified_at) of the vault's notes; none is opened."""
    return read_vault(spark, root, limit, bodies="false").select("path", "modified_at")


def note(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One note, or no row if there is none of that name inside the vault; nothing is listed and no other note opened."""
    return read_vault(spark, root, only=name)


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The vault as a stream (path, modified_at, content, deleted, text): each note when it was written, and a row without content when it went."""
    spark.dataSource.register(VaultChangeSource)
    return _with_text(spark.readStream.format("vault_changes").option("path", root).load())


def split_notes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Batches (path, modified_at, text) of notes as (path, modified_at, tags, fields, body), tags of the head alone."""
    rows = [head_and_body(t) for t in batch.column(2).to_pylist()]
    fields = [json.dumps({str(k): v for k, v in f.items()}, default=str, ensure_ascii=False) for f, _ in rows]
    cols = [pa.array([head_tags(f) for f, _ in rows], pa.list_(pa.string())), pa.array(fields, pa.string()), pa.array([b for _, b in rows], pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["path", "modified_at", "tags", "fields", "body"])


def parsed(files: DataFrame) -> DataFrame:
    """(path, modified_at, tags, fields, body) of vault files (path, modified_at, text): tags of the head and of the text, sorted, each once; the head's fields as JSON."""
    own = files.select("path", "modified_at", F.coalesce("text", F.lit("")).alias("text"))
    made = map_slices(own, split_notes, StructType([*own.schema.fields[:2], StructField("tags", ArrayType(StringType())), StructField("fields", StringType()), StructField("body", StringType())]))
    return made.withColumn("tags", F.array_sort(F.array_union("tags", inline_tags(F.col("body")))))
