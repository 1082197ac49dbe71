"""Notes as chunks: sections by headings and rules, long ones cut, small ones merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.batches import map_slices
from gleanery.functions.text import LINE_END, lines, stripped

# Fixed values of chunking: sizes in tokens of four characters, and the overlap of a cut.
MAX_TOKENS, MIN_TOKENS, OVERLAP_CHARS = 400, 40, 200
HEADING, FENCE, BREAK = r"^(#{1,6})\s+(.*)", r"^\s*(```|~~~)", r"^\s*(---+|\*\*\*+)\s*$"


def sections(notes: DataFrame, id_col: str = "note_id", body_col: str = "body") -> DataFrame:
    """(note_id, section, path, text) of every section with text, in order.

    Headings and rules end a section, except between fences. A heading closes those at its level or deeper, which windows
    over the note's lines find: per level the last heading, which is alive if it stands after the last of each level above it.
    """
    rows = notes.select(F.col(id_col).alias("note_id"), F.posexplode(lines(F.col(body_col))).alias("n", "line"))
    before = Window.partitionBy("note_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fences", F.sum(F.col("line").rlike(FENCE).cast("int")).over(before))
    outside = F.col("fences") % 2 == 0
    # the line of a closing fence is outside by count, and no heading or rule
    level = F.when(outside, F.length(F.regexp_extract("line", HEADING, 1)))
    rows = rows.withColumn("level", F.when(level > 0, level))
    rows = rows.withColumn("cut", F.col("level").isNotNull() | (outside & F.col("line").rlike(BREAK)))
    rows = rows.withColumn("section", F.sum(F.col("cut").cast("int")).over(before))
    title = stripped(F.regexp_extract("line", HEADING, 2))
    for k in range(1, 7):
        own = F.when(F.col("level") == k, F.struct(F.col("n").alias("at"), title.alias("title")))
        rows = rows.withColumn(f"h{k}", F.last(own, ignorenulls=True).over(before))
    newest, alive = F.lit(-1), []
    for k in range(1, 7):
        at = F.col(f"h{k}.at")
        alive.append(F.when(at > newest, F.col(f"h{k}.title")))
        newest = F.greatest(newest, F.coalesce(at, F.lit(-1)))
    rows = rows.withColumn("path", F.array_compact(F.array(*alive)))
    parts = rows.groupBy("note_id", "section").agg(F.sort_array(F.collect_list(F.when(~F.col("cut"), F.struct("n", "line")))).alias("l"), F.max_by("path", "n").alias("path"))
    text = stripped(F.array_join(F.col("l.line"), "\n"))
    return parts.select("note_id", "section", "path", text.alias("text")).filter(F.length("text") > 0)


#: What ends a section or matters for it, on a line of its own: a fence, a heading, a rule.
MARK = re.compile(r"^(?:(?P<fence>[^\S\n]*(?:```|~~~))|(?P<level>#{1,6})[^\S\n]+(?P<title>.*)|[^\S\n]*(?:---+|\*\*\*+)[^\S\n]*$)", re.M)
ENDS = re.compile(LINE_END)
BLANK = re.compile(r"\n\s*\n")
LIMIT_CHARS = 4 * MAX_TOKENS


def marked_sections(body: str) -> list[tuple[list[str], str]]:
    """(path, text) of a note's sections with text: the slices between its headings and rules."""
    text = ENDS.sub("\n", body)
    out, trail, start, code = [], {}, 0, False
    for m in [*MARK.finditer(text), None]:
        if m and m["fence"] is not None:
            code = not code
        elif m is None or not code:
            if own := text[start : m.start() if m else len(text)].strip():
                out.append(([trail[level] for level in sorted(trail)], own))
            if m:
                start = m.end()
                if m["level"]:
                    trail = {level: title for level, title in trail.items() if level < len(m["level"])} | {len(m["level"]): m["title"].strip()}
    return out


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """Paragraphs in order, and whether each stands alone: one that is too long gives full slices that do, ended at a space, and a rest that doesn't."""
    for paragraph in BLANK.split(text):
        rest = paragraph.strip()
        while len(rest) // 4 > MAX_TOKENS:
            head, space, _ = rest[:LIMIT_CHARS].rpartition(" ")
            yield (head if space and head else rest[:LIMIT_CHARS]), True
            rest = rest[len(head) if space and head else LIMIT_CHARS :].strip()
        if rest:
            yield rest, False


def pieces(text: str) -> list[str]:
    """A long section as pieces of whole paragraphs; a piece that follows a full one begins with that one's last words."""
    out: list[str] = []
    fill = False  # whether the last piece may take more
    for block, alone in blocks(text):
        if fill and not alone and (len(out[-1]) + len(block)) // 4 <= MAX_TOKENS:
            out[-1] += "\n\n" + block
        elif fill and not alone:
            _, space, words = out[-1][-OVERLAP_CHARS:].partition(" ")
            out.append((words if space else out[-1][-OVERLAP_CHARS:]) + "\n\n" + block)
        else:
            out.append(block)
        fill = not alone
    return out


def together(parts: list[tuple[list[str], str]]) -> list[tuple[list[str], str]]:
    """Parts (path, text) in groups that are large enough, each under its last part's path; what is left over joins the group before, under that one's."""
    groups: list[list[int]] = [[]]
    chars = 0
    for i, (_, text) in enumerate(parts):
        chars += len(text) + (2 if groups[-1] else 0)
        groups[-1].append(i)
        if chars // 4 >= MIN_TOKENS:
            groups.append([])
            chars = 0
    *full, rest = groups
    if full and rest:
        return [(parts[g[-1]][0], "\n\n".join(parts[i][1] for i in g + (rest if g is full[-1] else []))) for g in full]
    return [(parts[g[-1]][0], "\n\n".join(parts[i][1] for i in g)) for g in groups if g]


def note_chunks(body: str) -> list[tuple[list[str], str]]:
    """(path, text) of a note's chunks."""
    return together([(path, p) for path, text in marked_sections(body) for p in (pieces(text) if len(text) // 4 > MAX_TOKENS else [text])])


def chunks(notes: DataFrame, id_col: str = "note_id", body_col: str = "body") -> DataFrame:
    """(note_id, position, path, text) of every note's chunks, note by note over small Arrow batches: no shuffle. A null body has none."""
    own = notes.select(F.col(id_col).alias("note_id"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    kind = own.schema["note_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [note_chunks(b) for b in batch.column(1).to_pylist()]
        at = pa.array([r for r, m in enumerate(made) for _ in m], pa.int64())
        flat = [c for m in made for c in m]
        cols = [batch.column(0).take(at), pa.array([k for m in made for k in range(len(m))], pa.int32()), pa.array([p for p, _ in flat], pa.list_(pa.string())), pa.array([t for _, t in flat], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["note_id", "position", "path", "text"])

    return map_slices(own, run, f"note_id {kind}, position int, path array<string>, text string")


def item_chunks(items: DataFrame) -> DataFrame:
    """Chunks of items (note_id, title, excerpt, body): of the body, or if it is blank one of title and excerpt; nothing if those are blank too."""
    blank = stripped(F.coalesce(F.col("body"), F.lit(""))) == ""
    short = stripped(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("excerpt", F.lit(""))))
    one = items.filter(blank).select("note_id", F.lit(0).alias("position"), F.array().cast("array<string>").alias("path"), short.alias("text")).filter("text <> ''")
    return chunks(items.filter(~blank)).unionByName(one)
