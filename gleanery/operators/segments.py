"""A keyword index kept up to date: postings in segments that are never changed.

Each addition writes one segment, the postings of the documents that are new or replaced, and
one list of tombstones, the ids among them that older segments have. A posting is live if no
tombstone of a later commit names its document. A commit (see sources.commits) lists segments and
tombstones; a search reads the live set as of one commit. Where there are many small segments, the
smallest are merged into one, without what is dead in them; tombstones that no older segment is left for are
dropped. Of two jobs that add at once, one commits and the other adds again.

Each task writes the postings of its documents as lists by lexeme and weight, so they are computed once and none is sent
anywhere. The lists of some megabytes of texts are a run, in the order of its lexemes; few tasks have more than one. Where an index
follows a table, the texts are dealt to as many tasks as the size of its files asks for, so what a task gathers stays the same however
large the files are. A search skips the pages of each file whose least and greatest lexemes exclude its words.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.operators import lexical
from gleanery.sources.commits import Commits, Conflict

#: Segments beyond which the smallest are merged.
MOST_SEGMENTS = 8
#: Bytes of a table's files, and postings of merged segments, whose postings one task gathers and writes.
TASK_BYTES, TASK_POSTINGS = 4 << 20, 2 << 20
#: Lists of a page, of which a search reads those that may have its words.
PAGE_LISTS = 1000

Make = Callable[[DataFrame], DataFrame]


class Segments:
    """An index under a folder. ``make`` gives the postings of items (entity_id, ...), as rows (entity_id, lexeme, pos, weight) or as lists of them."""

    def __init__(self, spark: SparkSession, folder: str, make: Make, most: int = MOST_SEGMENTS) -> None:
        self.spark, self.make, self.most = spark, make, most
        self.commits = Commits(spark, folder)
        self.folder = self.commits.folder

    def _read(self, name: str, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/{name}")

    def _postings(self, entry: dict, segments: list[dict]) -> DataFrame:
        """Live postings of some of a commit's segments."""
        kind = entry["id_type"]
        parts = [lexical.spread(self._read(f"{s['name']}/postings", lexical.lists_schema(kind))).withColumn("segment", F.lit(s["number"])) for s in segments]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        if not entry["dead"]:
            return rows.drop("segment")
        dead = reduce(lambda a, b: a.unionByName(b), [self._read(d["name"], f"entity_id {kind}").withColumn("died", F.lit(d["number"])) for d in entry["dead"]])
        last = dead.groupBy("entity_id").agg(F.max("died").alias("died"))
        gone = (rows["entity_id"] == last["entity_id"]) & (rows["segment"] < last["died"])
        return rows.join(last, gone, "left_anti").drop("segment")

    def documents(self, entry: dict) -> DataFrame:
        """(entity_id, file, segment) of the documents that each segment has, dead ones too."""
        parts = [self._read(f"{s['name']}/documents", f"entity_id {entry['id_type']}, file string").withColumn("segment", F.lit(s["number"])) for s in entry["segments"]]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def live(self) -> DataFrame:
        """The postings that a search reads."""
        _, entry = self.commits.latest()
        if not entry.get("segments"):
            return self.spark.createDataFrame([], f"entity_id {entry.get('id_type', 'long')}, lexeme string, pos int, weight string")
        return self._postings(entry, entry["segments"])

    def _store(self, name: str, postings: DataFrame) -> None:
        own = postings if "positions" in postings.columns else lexical.gathered(postings)
        own.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_LISTS).parquet(f"{self.folder.path}/{name}/postings")

    def add(self, items: DataFrame, gone: DataFrame | None = None, files: list[str] = (), dropped: list[str] = (), tries: int = 5, tasks: int | None = None) -> int:
        """Adds items (entity_id, ..., and ``file`` if the index follows a table); those with a known id replace it. Documents ``gone`` (entity_id) leave.

        ``files`` and ``dropped`` are the names of files that the commit adds to those it has read, and takes away.
        ``tasks`` is how many share the making of postings; without it, each reads its own items. Gives the commit's number.
        """
        name = f"segment-{uuid.uuid4().hex}"
        columns = [c for c in items.columns if c != "file"]
        own = items.select(*columns)
        self._store(name, self.make(own.repartition(tasks, "entity_id") if tasks else own))
        held = items.select("entity_id", F.col("file") if "file" in items.columns else F.lit("").alias("file"))
        held.write.parquet(f"{self.folder.path}/{name}/documents")
        held = self._read(f"{name}/documents", held.schema)
        kind, n = held.schema["entity_id"].dataType.simpleString(), held.count()
        for left in reversed(range(tries)):
            at = self.commits.latest()
            number, entry = at[0] + 1, at[1] or {"segments": [], "dead": [], "files": [], "id_type": kind}
            leaving = held.select("entity_id") if gone is None else held.select("entity_id").union(gone.select("entity_id"))
            dead = list(entry["dead"])
            if entry["segments"]:
                graves = f"dead-{uuid.uuid4().hex}"
                self.documents(entry).select("entity_id").join(leaving.distinct(), "entity_id", "left_semi").distinct().write.parquet(f"{self.folder.path}/{graves}")
                if count := self._read(graves, f"entity_id {kind}").count():
                    dead.append({"name": graves, "number": number, "documents": count})
            known = [f for f in entry["files"] if f not in set(dropped)] + list(files)
            new = {"segments": [*entry["segments"], *([{"name": name, "number": number, "documents": n}] if n else [])], "dead": dead, "files": known, "id_type": kind}
            if self.commits.put(number, new):
                return self.merge()
            if not left:
                raise Conflict("other writers were faster each time")
        raise AssertionError

    def merge(self) -> int:
        """Merges the smallest segments into one if there are more than ``most``; gives the newest commit's number. If another writer is faster, nothing is merged this time."""
        number, entry = self.commits.latest()
        segments = sorted(entry["segments"], key=lambda s: s["documents"])
        if len(segments) <= self.most:
            return number
        small, rest = segments[: len(segments) - self.most // 2], segments[len(segments) - self.most // 2 :]
        newest = max(s["number"] for s in small)
        name = f"segment-{uuid.uuid4().hex}"
        rows = self._postings(entry, small)
        self._store(name, rows.repartition(math.ceil(max(1, rows.count()) / TASK_POSTINGS), "entity_id"))
        documents = self.documents(entry | {"segments": small})
        if entry["dead"]:
            dead = reduce(lambda a, b: a.unionByName(b), [self._read(d["name"], f"entity_id {entry['id_type']}").withColumn("died", F.lit(d["number"])) for d in entry["dead"]])
            last = dead.groupBy("entity_id").agg(F.max("died").alias("died")).withColumnRenamed("entity_id", "id")
            documents = documents.join(last, (F.col("entity_id") == F.col("id")) & (F.col("segment") < F.col("died")), "left_anti")
        documents.select("entity_id", "file").write.parquet(f"{self.folder.path}/{name}/documents")
        merged = {"name": name, "number": newest, "documents": self._read(f"{name}/documents", "file string").count()}
        left = [*rest, *([merged] if merged["documents"] else [])]
        oldest = min((s["number"] for s in left), default=number + 1)
        self.commits.put(number + 1, entry | {"segments": sorted(left, key=lambda s: s["number"]), "dead": [d for d in entry["dead"] if d["number"] > oldest]})
        return self.commits.latest()[0]


def files_of(table: DataFrame) -> DataFrame:
    """(file) of a table of files: a name for each as it is now, with its size and time, so a file that is written anew has another. No file is read."""
    files = table.inputFiles()
    if not files:
        return table.sparkSession.createDataFrame([], "file string")
    return table.sparkSession.read.format("binaryFile").load(files).select(file_name())


def file_name() -> Column:
    return F.concat_ws("|", "_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time")).alias("file")


def followed(index: Segments, table: DataFrame, items: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The live postings of a table of Parquet files, brought up to date first: new files make a segment, the documents of files that are gone or were written anew leave.

    ``items`` makes items (entity_id, title, body) of the table's rows; ids differ between files. Only new files are read.
    """
    spark = table.sparkSession
    now = {r["file"] for r in files_of(table).collect()}  # one name a file, as the table's listing on the driver has them
    _, entry = index.commits.latest()
    known = set(entry.get("files", []))
    if now == known and entry:
        return index.live()
    fresh, dropped = sorted(now - known), sorted(known - now)
    paths = [f.rsplit("|", 2)[0] for f in fresh]
    rows = spark.read.schema(table.schema).parquet(*paths) if paths else table.limit(0)
    made = items(rows.withColumn("file", file_name()) if paths else rows.withColumn("file", F.lit("")))
    gone = None
    if dropped and entry.get("segments"):
        gone = index.documents(entry).join(F.broadcast(spark.createDataFrame([(f,) for f in dropped], "file string")), "file", "left_semi").select("entity_id")
    index.add(made, gone, fresh, dropped, tasks=math.ceil(sum(int(f.rsplit("|", 2)[1]) for f in fresh) / TASK_BYTES))
    return index.live()
