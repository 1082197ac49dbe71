"""A table in hash buckets of its key, of which a write replaces only those that it touches.

The commit (see ``commits``) names for each bucket the folder that holds it now, so a bucket's version is its
folder. A reader keeps to one commit and sees nothing of later ones. A writer says which buckets it
has read; if one of them has another folder by the time of its commit, another writer was faster, and the
commit is refused with nothing visible written. Writers of different buckets don't disturb each other.

The number of buckets is fixed when the table is made; the list of buckets in a commit has as many entries at most.

Tables that must change together share a folder under names of their own: ``commit`` takes the changes of several
and commits all or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.sources.commits import Commits, Conflict

BUCKETS = 64

State = tuple[int, dict]


class Buckets:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS, name: str = "rows") -> None:
        self.spark, self.schema, self.keys, self.name = spark, schema, list(keys), name
        self.commits = Commits(spark, folder)
        self.folder = self.commits.folder
        _, entry = self.commits.latest()
        self.n = entry.get("n", {}).get(name, buckets)

    def state(self) -> State:
        """The newest commit."""
        return self.commits.latest()

    def held(self, entry: dict) -> dict[str, str]:
        """The folder of each bucket of this table."""
        return entry.get("buckets", {}).get(self.name, {})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into, ``n`` at most."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, state: State | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The table as of a commit, the newest if none is given; of ``only`` these buckets."""
        _, entry = state or self.state()
        held = self.held(entry)
        paths = [f"{self.folder.path}/{held[k]}" for k in sorted(held, key=int) if only is None or int(k) in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def prepared(self, state: State, rows: DataFrame, touched: Sequence[int], read: Sequence[int] | None = None) -> Change:
        """Writes ``rows`` as the whole content of the ``touched`` buckets, to be committed: made from what ``state`` had in the buckets ``read`` (all touched ones if not given)."""
        fresh: dict[str, str] = {}
        if touched:
            name = f"data-{uuid.uuid4().hex}"
            # a large bucket becomes several files
            placed = rows.select(*self.schema.names, self.bucket().alias("_bucket")).hint("rebalance", "_bucket")
            placed.write.partitionBy("_bucket").parquet(f"{self.folder.path}/{name}")
            fresh = {n.partition("=")[2]: f"{name}/{n}" for n in self.folder.names(name) if n.startswith("_bucket=")}
            if stray := fresh.keys() - {str(b) for b in touched}:
                raise ValueError(f"rows of buckets that aren't said to be touched: {sorted(stray)}")
        return Change(self, state, fresh, {str(b) for b in touched}, [str(b) for b in (touched if read is None else read)])

    def write(self, state: State, rows: DataFrame, touched: Sequence[int], read: Sequence[int] | None = None, marks: dict | None = None) -> int:
        """Commits such a change. ``marks`` are kept with the commit and those after it. Raises ``Conflict`` if another writer has changed one of the buckets read."""
        return commit(state, [self.prepared(state, rows, touched, read)], marks)

    def create(self, rows: DataFrame) -> int:
        """Commits the first content; refused if there is one."""
        at = self.state()
        if self.name in at[1].get("n", {}):
            raise Conflict("the table is there already")
        every = list(range(self.n))
        return self.write(at, rows, every)


@dataclass
class Change:
    """What was written for a table and isn't committed yet."""

    table: Buckets
    state: State
    fresh: dict[str, str]
    touched: set[str]
    read: list[str]

    def onto(self, entry: dict) -> dict[str, str]:
        """The table's buckets with this change; ``Conflict`` if one that was read has been written since."""
        had, now = self.table.held(self.state[1]), self.table.held(entry)
        if changed := [b for b in self.read if now.get(b) != had.get(b)]:
            raise Conflict(f"buckets {changed} of {self.table.name} were written after commit {self.state[0]}")
        return {k: v for k, v in now.items() if k not in self.touched} | self.fresh


def commit(state: State, changes: Sequence[Change], marks: dict | None = None) -> int:
    """Commits the changes of tables in one folder, all of them or none."""

    def build(entry: dict) -> dict:
        return {
            "n": entry.get("n", {}) | {c.table.name: c.table.n for c in changes},
            "buckets": entry.get("buckets", {}) | {c.table.name: c.onto(entry) for c in changes},
            "marks": entry.get("marks", {}) | (marks or {}),
        }

    return changes[0].table.commits.commit(state, build)
