"""A Merkle manifest of a dataset: a tree of digests for each source, one tree over the sources, and a proof for each row.

A row's leaf is the digest of its columns, each with its length in front, so no two rows of
different values have one leaf's input. Rows of a source stand in the order of their ids; every ``FANOUT``
consecutive nodes have their joint digest as parent until one node is left, the source's
root. The sources' roots, in the order of the sources, are the leaves of the tree whose
root names the dataset.

Places come from a sort by range: each sorted part knows its rows, and sums over the parts say
where it begins, so a source may hold any share of all rows. A level is one pivot: conditional
aggregates spread the children of a parent into ``FANOUT`` columns by slot; their concatenation is the
parent's digest, and without the own slot's column it gives a node's siblings, those before
and those behind it. Pivots are written as the trees grow. On the way down each parent hands its
path, the siblings on all levels above, to its children; only parents move with paths, not rows.

A null has a mark of its own, so it differs from an empty text. Null sources are a source of
their own, the first; null ids come first in it. Rows with one id stand in the order of their
leaves, and repeated rows have leaves of their own. An empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize
from gleanery.llm.exact import sent

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The bits of an id of ``monotonically_increasing_id`` that number a part's rows.
PART_BITS = 33


def digest(values: Column) -> Column:
    return F.sha2(values, 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values: ``-`` for a null, else the bytes' number, a colon and the value."""
    shown = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown)))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their place in their tree (``pos``, from 0) by ``order``, and the tree's size ``n``."""
    at = materialize(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", PART_BITS))
    runs = at.groupBy("tree", "part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("rows"))
    begins = materialize(runs.selectExpr("tree", "part", "sum(rows) OVER (PARTITION BY tree ORDER BY part) - rows - least AS shift", "sum(rows) OVER (PARTITION BY tree) AS n"), "begins")
    found = at.join(sent(begins, begins.count()), ["tree", "part"])
    return found.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def pivoted(nodes: DataFrame, *carried: str) -> DataFrame:
    """A row for each parent (tree, parent, n, and a column for each slot of ``node`` and what is carried)."""
    slot = F.pmod(F.col("pos"), F.lit(FANOUT))
    spread = [F.max(F.when(slot == k, F.col(c))).alias(f"{c}{k}") for c in ("node", *carried) for k in range(FANOUT)]
    return nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("parent"), "n").agg(*spread)


def children(*columns: str) -> Column:
    """The slots' columns as an array of what stands in them."""
    slots = [F.struct(*(F.col(f"{c}{k}").alias(c) for c in columns)) for k in range(FANOUT)]
    return F.filter(F.array(*slots), lambda s: s["node"].isNotNull())


def joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda s: s["node"]), "")


def grown(leaves: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, the leaves' first, and (tree, node): each tree's root. A tree that is down to one node hands it on."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    pivots: list[DataFrame] = []
    nodes = leaves
    while not pivots or most > 1:
        pivots.append(materialize(pivoted(nodes, *(() if pivots else carried)), "level"))
        node = F.when(F.col("n") == 1, F.col("node0")).otherwise(digest(F.concat_ws("", *(f"node{k}" for k in range(FANOUT)))))
        nodes = pivots[-1].select("tree", F.col("parent").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), node.alias("node"))
        most = -(-most // FANOUT)
    return pivots, nodes.select("tree", "node")


def unfolded(pivots: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """(tree, pos, node, carried, path, and what else ``tops`` (tree, path, ...) holds) of every leaf.

    A path has the siblings before and behind a node, one pair a level from below, its tree's root's path at its end.
    """
    held = [c for c in tops.columns if c not in ("tree", "path")]
    above = tops.withColumn("parent", F.lit(0).cast("long"))
    for level in reversed(range(len(pivots))):
        own = ("node",) if level else ("node", *carried)
        found = pivots[level].join(above, ["tree", "parent"]).select("tree", "parent", "n", "path", *held, children(*own).alias("kids"))
        kids = found.select("*", F.posexplode("kids").alias("slot", "kid")).withColumns({c: F.col(f"kid.{c}") for c in own})
        kids = kids.withColumns({"before": joined(F.slice("kids", 1, F.col("slot"))), "behind": joined(F.slice("kids", F.col("slot") + 2, FANOUT))})
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(F.struct("before", "behind")), "path"))
        nodes = kids.select("tree", (F.col("parent") * FANOUT + F.col("slot")).alias("parent"), *own, path.alias("path"), *held)
        above = materialize(nodes.drop("node"), "paths") if level > 1 else nodes.drop("node") if level else nodes
    return above.withColumnRenamed("parent", "pos")


def siblings(path: Column) -> Column:
    """All siblings' digests on the way to the root, level by level from the left."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["behind"])), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda d, s: digest(F.concat(s["before"], d, s["behind"])))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = COLUMNS, claimed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, claimed_leaf, folded_root, verified) of every row.

    ``claimed`` holds expressions for columns as they are claimed to be; a row's claimed leaf is the leaf of those values, and it is verified
    if that leaf and the row's path give the root of the true values.
    """
    held = {c: F.col(f"`{c}`") for c in columns}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))  # null first, then by bytes
    rows = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), leaf(list(held.values())).alias("node"), leaf(list((held | (claimed or {})).values())).alias("claim"))
    pivots, roots = grown(ranked(rows, "doc_id", "node"), "doc_id", "claim")
    sources = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), "source")
    upper, root = grown(sources, "source")
    top = root.first()
    none = F.array().cast("array<struct<before:string,behind:string>>")
    names = unfolded(upper, root.select("tree", none.alias("path")), "source")
    tops = materialize(names.select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "path"), "sources")
    found = unfolded(pivots, tops, "doc_id", "claim")
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(top["node"] if top else None).cast("string").alias("root"), "path", F.col("claim").alias("claimed_leaf"), folded(F.col("claim"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
