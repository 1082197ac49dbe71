"""The graph of links between notes (path, title, body), its degrees, and the rules on links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import file_stem, link_key, link_targets


@dataclass(frozen=True)
class Rules:
    """What a vault's owner allows, by notes' names in lower case: the page that lists projects, pages that may link to each other, notes with set links."""

    index: str = "projects index"
    pairs: tuple[tuple[str, str], ...] = ()
    only_links: Mapping[str, Sequence[str]] = field(default_factory=dict)


def name_of(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", ""))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.lower(F.regexp_extract(path, r"^(.*)/", 1))).otherwise("")


def links(notes: DataFrame) -> DataFrame:
    """(source, nth, target) of every link, resolved or not."""
    return notes.select(F.col("path").alias("source"), F.posexplode(link_targets(F.coalesce(F.col("body"), F.lit("")))).alias("nth", "target"))


def resolved(notes: DataFrame, order: str = "nth") -> DataFrame:
    """(source, nth, target, found): by the exact path, else by the file name, whose shortest path wins; found is null if neither is there.

    Of notes whose paths differ in case alone, the last by ``order`` is the one that is linked.
    """
    by_path = notes.groupBy(link_key(F.col("path")).alias("key")).agg(F.max_by("path", order).alias("exact"))
    shortest = Window.partitionBy("name").orderBy(F.length("path"), "path")
    named = notes.select("path", link_key(F.element_at(F.split("path", "/"), -1)).alias("name"))
    by_name = named.withColumn("n", F.row_number().over(shortest)).filter("n = 1").select("name", F.col("path").alias("near"))
    found = links(notes).withColumn("key", link_key(F.col("target"))).withColumn("name", link_key(F.element_at(F.split("target", "/"), -1)))
    both = found.join(by_path, "key", "left").join(by_name, "name", "left")
    return both.select("source", "nth", "target", F.coalesce("exact", "near").alias("found"))


def edges(notes: DataFrame, order: str = "nth") -> DataFrame:
    """(source, found): distinct links between different notes."""
    own = resolved(notes, order)
    return own.filter(F.col("found").isNotNull() & (F.col("found") != F.col("source"))).select("source", "found").distinct()


def unresolved(notes: DataFrame, order: str = "nth") -> DataFrame:
    """One row: how many links lead nowhere, each occurrence counted."""
    return resolved(notes, order).agg(F.count_if(F.col("found").isNull()).alias("unresolved"))


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, degree) of nodes (node), over edges (source, found) at both ends; those without edges have 0."""
    ends = pairs.select(F.explode(F.array("source", "found")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("degree"))


def neighbours(pairs: DataFrame, node) -> DataFrame:
    """(neighbour) of a node, in either direction, each once."""
    out = pairs.filter(F.col("source") == F.lit(node)).select(F.col("found").alias("neighbour"))
    return out.union(pairs.filter(F.col("found") == F.lit(node)).select("source")).distinct()


def backlinks(notes: DataFrame, order: str = "nth") -> DataFrame:
    """(target, sources): who links to each note, by title, sorted."""
    titles = notes.select(F.col("path").alias("source"), file_stem(F.col("path")).alias("title"))
    return edges(notes, order).join(titles, "source").groupBy(F.col("found").alias("target")).agg(F.sort_array(F.collect_list("title")).alias("sources"))


def by_proximity(notes: DataFrame) -> DataFrame:
    """(source, nth, target, found): by the path from the root, else by file name; of several, the one that shares most leading folders with the source, then the shallowest."""
    folders = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    named = notes.select(F.col("path").alias("found"), link_key(F.element_at(F.split("path", "/"), -1)).alias("name"))
    exact = notes.select(F.col("path").alias("exact"), link_key(F.col("path")).alias("key"))
    own = links(notes).withColumn("key", link_key(F.col("target"))).withColumn("name", link_key(F.element_at(F.split("target", "/"), -1)))
    candidates = own.join(exact, "key", "left").join(named, "name", "left")
    same = F.zip_with(folders(F.col("source")), folders(F.col("found")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    best = Window.partitionBy("source", "nth").orderBy(F.desc(shared), F.size(F.split("found", "/")), "found")
    return candidates.withColumn("n", F.row_number().over(best)).filter("n = 1").select("source", "nth", "target", F.coalesce("exact", "found").alias("found"))


def is_adr(path: Column) -> Column:
    return name_of(path).rlike(r"^adr-\d+")


def is_architecture(path: Column) -> Column:
    return name_of(path).contains("architecture overview")


def beside(path: Column, adr: Column) -> Column:
    """A sibling decision record, or the architecture page of its folder."""
    return (folder_of(path) == folder_of(adr)) & (is_adr(path) | is_architecture(path))


def problems(notes: DataFrame, only: str | None = None, order: str = "nth", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(rule, source, target) of every broken rule. An edge breaks at most one of the first four.

    fixed-links: a note with set links links elsewhere. adr-source, adr-target: a decision record shares a link with a note that is
    no neighbour of it. projects: two project pages link. many-projects: another note links to several project pages (target null).
    unlisted: no architecture page links to a decision record (target null; only without ``only``).
    """
    all_edges = edges(notes, order)
    projects = all_edges.filter(name_of(F.col("source")) == rules.index).select(F.col("found").alias("project")).distinct()
    own = all_edges if only is None else all_edges.filter(F.col("source") == only)
    marked = own.join(projects.select(F.col("project").alias("found"), F.lit(True).alias("to_project")), "found", "left").join(projects.select(F.col("project").alias("source"), F.lit(True).alias("from_project")), "source", "left")
    s, t = F.col("source"), F.col("found")
    fixed = F.lit(False)
    for note in rules.only_links:
        fixed = fixed | (name_of(s) == note)
    allowed = F.lit(False)
    for note, names in rules.only_links.items():
        allowed = allowed | ((name_of(s) == note) & name_of(t).isin(list(names)))
    pair = F.lit(False)
    for a, b in rules.pairs:
        pair = pair | ((name_of(s) == a) & (name_of(t) == b)) | ((name_of(s) == b) & (name_of(t) == a))
    project_edge = F.coalesce("to_project", F.lit(False)) & (name_of(s) != rules.index)
    rule = (
        F.when(fixed & ~allowed, "fixed-links")
        .when(is_adr(s), F.when(~beside(t, s), "adr-source"))
        .when(is_adr(t), F.when(~beside(s, t), "adr-target"))
        .when(project_edge & F.coalesce("from_project", F.lit(False)), F.when(~pair, "projects"))
        .when(project_edge, "to-project")
    )
    judged = marked.select(rule.alias("rule"), "source", F.col("found").alias("target")).filter(F.col("rule").isNotNull())
    many = judged.filter("rule = 'to-project'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = judged.filter("rule <> 'to-project'").unionByName(many.select(F.lit("many-projects").alias("rule"), "source", F.lit(None).cast("string").alias("target")))
    if only is not None:
        return out
    listed = all_edges.filter(is_architecture(s) & beside(s, t)).select(F.col("found").alias("path")).distinct()
    bare = notes.filter(is_adr(F.col("path"))).select("path").join(listed, "path", "left_anti")
    return out.unionByName(bare.select(F.lit("unlisted").alias("rule"), F.col("path").alias("source"), F.lit(None).cast("string").alias("target")))
