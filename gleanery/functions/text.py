"""Expressions over note texts. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the note format: fences and inline code, tags, links, syntax at line starts.
FENCE = r"(?ms)^(```|~~~).*?^\1"
INLINE_CODE = r"`[^`\n]*`"
INLINE_TAG = r"(?:^|\s)#([A-Za-z][\w/-]*)"
WIKILINK = r"!?\[\[([^\]\n]+)\]\]"
SYNTAX = r"^[#>\-*\s]+|\*\*|__|[*_`]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
EXCERPT_CHARS, TITLE_CHARS, INDEX_EXCERPT_CHARS, CAPTURE_TITLE_CHARS, FILENAME_CHARS = 240, 200, 500, 80, 80


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")


def without_code(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, FENCE, " "), INLINE_CODE, " ")


def lines(c: Column) -> Column:
    """The lines of a text; a line end at its end starts none."""
    parts = F.split(c, LINE_END, -1)
    return F.when((F.element_at(parts, -1) == "") & (F.size(parts) >= 1), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def inline_tags(body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(without_code(body), F.lit(INLINE_TAG), 1)))


def excerpt(body: Column) -> Column:
    """A preview of the prose: links by their alias, without markdown, 240 characters at most."""
    text = F.regexp_replace(without_code(body), r"!?\[\[(?:[^\]\n]*\|)?([^\]\n|]*)\]\]", "$1")
    kept = F.filter(F.transform(lines(text), lambda x: stripped(F.regexp_replace(x, SYNTAX, ""))), lambda x: x != "")
    joined = F.array_join(kept, " ")
    return F.when(F.length(joined) > EXCERPT_CHARS, F.concat(F.rtrim(F.substring(joined, 1, EXCERPT_CHARS)), F.lit("…"))).otherwise(joined)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def first_line_title(body: Column) -> Column:
    first = F.substring(F.element_at(F.split(body, LINE_END, 2), 1), 1, CAPTURE_TITLE_CHARS)
    return F.when(F.length(first) > 0, first).otherwise(F.lit("(empty)"))


def joined_parts(*parts: Column) -> Column:
    return F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts))


def fingerprint(text: Column, version: int = 6) -> Column:
    """Changes with the text and with the version of the indexing logic."""
    return F.sha2(F.concat(F.lit(f"v{version}\n"), text), 256)


def tokens(text: Column) -> Column:
    """A rough count: a token has about four characters."""
    return F.floor(F.length(text) / 4).cast("int")


def embedding_text(title: Column, path: Column, text: Column, mode: str) -> Column:
    """What is embedded: the text with no header, the nearest heading, or the title and all headings."""
    if mode == "section":
        return F.when(F.size(path) > 0, F.concat(F.element_at(path, -1), F.lit("\n\n"), text)).otherwise(text)
    if mode == "full":
        return F.concat(F.concat_ws(" › ", title, path), F.lit("\n\n"), text)
    return text


def tag_normalised(tag: Column) -> Column:
    """One spelling for a tag: lower case, hyphens for spaces, nothing but letters, digits, slashes and hyphens."""
    c = F.lower(F.regexp_replace(stripped(tag), "^#+", ""))
    c = F.regexp_replace(c, r"[\s_]+", "-")
    c = F.regexp_replace(c, "[^a-z0-9/-]", "")
    return F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), "^-+|-+$", "")


def safe_filename(title: Column) -> Column:
    """Text as a file name that can't leave its folder or hide."""
    c = F.regexp_replace(title, r'[/\\:*?"<>|\x00-\x1f]', " ")
    c = F.substring(F.regexp_replace(c, r"\s+", " "), 1, FILENAME_CHARS)
    c = F.regexp_replace(c, "^[. ]+|[. ]+$", "")
    return F.when(c == "", F.lit("Untitled")).otherwise(c)


def link_targets(body: Column) -> Column:
    """Note names that a body links to, in order, without aliases, headings and block marks; attachments are left out."""
    raw = F.regexp_extract_all(without_code(body), F.lit(WIKILINK), 1)
    names = F.transform(raw, lambda x: stripped(F.regexp_extract(x, r"^([^|#^]*)", 1)))
    md = lambda x: F.lower(x).endswith(".md")
    kept = F.filter(names, lambda x: md(x) | ~F.element_at(F.split(x, "/"), -1).contains("."))
    bare = F.transform(kept, lambda x: F.regexp_replace(x, r"(?i)\.md$", ""))
    return F.filter(bare, lambda x: x != "")


def link_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?i)\.md$", ""))


def without_thoughts(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>\s*", "")
