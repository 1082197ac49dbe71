"""Text, chunking, links and tags over a small vault given row by row: the driver's tables hold no notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import chunking, graph, tags
from gleanery.plans.registry import Registry
from gleanery.sources.tables import Literal, table

R = Registry()

FILLER = " ".join(["walking"] * 60)
NOTES = Literal(
    "notes",
    "nth int, path string, body string",
    [
        (1, "Projects Index.md", "All of them: [[Harbor Map]], [[Lantern Project|the tour]] and [[tide tables#Start]]. #note"),
        (2, "Work/Harbor Map.md", "A home for [[Lantern Project]] things. `[[Not A Link]]` #project #Harbor-Map\n\n```\n[[Nor This]] #nor\n```\nSee [[picture.png]] and [[Tide Tables.md]]."),
        (3, "Work/Lantern Project.md", "Pairs with [[Tide Tables]]. Missing: [[Nowhere]], [[Nowhere^b1]] #project"),
        (4, "Deep/er/Tide Tables.md", "Back to [[work/lantern project]] and to itself [[Tide Tables]] #project #speech/tts"),
        (5, "Tide Tables.md", "A shorter path wins the name. **Bold** and _em_ text\n> quote\n- item one\n- item two"),
        (6, "Life/Fixed Page.md", "Linked to [[Harbor Map]] and [[Some Note]] #résumé"),
        (7, "Life/Some Note.md", "Two homes: [[Harbor Map]] and [[Lantern Project]], twice [[Harbor Map]] #learning #Machine_Learning"),
        (8, "OS/adr/ADR-001 storage.md", "Beside [[ADR-002 search]] but not [[Some Note]]"),
        (9, "OS/adr/ADR-002 search.md", "Fine"),
        (10, "OS/adr/Architecture Overview.md", "Decisions: [[ADR-001 storage]]"),
        (11, "Life/Reader.md", "Reads [[ADR-001 storage]] ~~~ [[v1.2 plan]]"),
        (12, "Life/Empty.md", None),
        (13, "Life/Long.md", "# First\n" + FILLER * 4 + "\n~~~\n[[Hidden]]\n~~~\nlast line " + "x" * 30),
    ],
)

RULES = graph.Rules(pairs=(("lantern project", "tide tables"),), only_links={"fixed page": ["harbor map", "projects index"]})

NO_CODE = "regexp_replace(regexp_replace(coalesce(body, ''), '(?ms)^```.*?^```|^~~~.*?^~~~', ' ', 'g'), '`[^`' || chr(10) || ']*`', ' ', 'g')"
LINKS_SQL = f"""{NOTES.sql()},
raw AS (SELECT path AS source, unnest(regexp_extract_all({NO_CODE}, '!?\\[\\[([^\\]\\n]+)\\]\\]', 1)) AS r, unnest(range(0, len(regexp_extract_all({NO_CODE}, '!?\\[\\[([^\\]\\n]+)\\]\\]', 1)))) AS k FROM notes),
names AS (SELECT source, k, trim(regexp_extract(r, '^([^|#^]*)', 1)) AS n FROM raw),
links AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS nth, regexp_replace(n, '(?i)\\.md$', '') AS target FROM names
  WHERE (lower(n) LIKE '%.md' OR NOT contains(string_split(n, '/')[-1], '.')) AND n <> '')"""
EDGES_SQL = f"""{LINKS_SQL},
by_path AS (SELECT lower(regexp_replace(path, '(?i)\\.md$', '')) AS key, max_by(path, nth) AS exact FROM notes GROUP BY 1),
by_name AS (SELECT lower(regexp_replace(string_split(path, '/')[-1], '(?i)\\.md$', '')) AS name, path AS near FROM notes QUALIFY row_number() OVER (PARTITION BY 1 + 0, name ORDER BY length(path), path) = 1),
resolved AS (SELECT source, nth, target, coalesce(exact, near) AS found FROM links
  LEFT JOIN by_path ON key = lower(target) LEFT JOIN by_name ON name = lower(string_split(target, '/')[-1])),
edges AS (SELECT DISTINCT source, found FROM resolved WHERE found IS NOT NULL AND found <> source)"""


def notes(spark: SparkSession) -> DataFrame:
    return NOTES.df(spark)


@R.query(f"WITH {LINKS_SQL} SELECT source, nth::INTEGER AS nth, target FROM links")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.links(notes(spark))


@R.query(f"WITH {EDGES_SQL} SELECT source, nth::INTEGER AS nth, target, found FROM resolved")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved(notes(spark))


@R.query(f"WITH {EDGES_SQL} SELECT source, found FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(notes(spark))


@R.query(f"WITH {EDGES_SQL} SELECT count(*) FILTER (found IS NULL)::BIGINT AS unresolved FROM resolved")
def graph_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unresolved(notes(spark))


@R.query(
    f"""WITH {EDGES_SQL}, titled AS (SELECT found, regexp_replace(string_split(source, '/')[-1], '\\.md$', '') AS title FROM edges)
SELECT found AS target, string_agg(title, '; ' ORDER BY title) AS sources FROM titled GROUP BY found"""
)
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backlinks(notes(spark)).withColumn("sources", F.array_join("sources", "; "))


@R.query(
    f"""WITH {EDGES_SQL},
cand AS (SELECT l.source, l.nth, l.target, p.exact, n.path AS near, string_split(l.source, '/') AS a, string_split(n.path, '/') AS b FROM links l
  LEFT JOIN by_path p ON p.key = lower(l.target) LEFT JOIN notes n ON lower(regexp_replace(string_split(n.path, '/')[-1], '(?i)\\.md$', '')) = lower(string_split(l.target, '/')[-1])),
shared AS (SELECT *, CASE WHEN near IS NULL OR len(a) < 2 OR len(b) < 2 OR a[1] <> b[1] THEN 0 WHEN len(a) < 3 OR len(b) < 3 OR a[2] <> b[2] THEN 1 ELSE 2 END AS s FROM cand)
SELECT source, nth::INTEGER AS nth, target, coalesce(exact, near) AS found FROM shared QUALIFY row_number() OVER (PARTITION BY source, nth ORDER BY s DESC, len(b), near) = 1"""
)
def link_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_proximity(notes(spark))


RULES_SQL = f"""{EDGES_SQL},
facts AS (SELECT path, lower(regexp_replace(string_split(path, '/')[-1], '\\.md$', '')) AS name, lower(regexp_extract(path, '^(.*)/', 1)) AS folder FROM notes),
kinds AS (SELECT *, regexp_matches(name, '^adr-[0-9]+') AS adr, contains(name, 'architecture overview') AS arch FROM facts),
projects AS (SELECT DISTINCT found AS path FROM edges JOIN facts ON source = path WHERE name = 'projects index'),
wide AS (SELECT e.source, e.found AS target, s.name AS sn, t.name AS tn, s.adr AS sa, t.adr AS ta, s.folder = t.folder AND (t.adr OR t.arch) AS t_beside, s.folder = t.folder AND (s.adr OR s.arch) AS s_beside,
    e.source IN (FROM projects) AS sp, e.found IN (FROM projects) AS tp, s.arch AS sarch
  FROM edges e JOIN kinds s ON s.path = e.source JOIN kinds t ON t.path = e.found),
judged AS (SELECT CASE
    WHEN sn = 'fixed page' AND tn NOT IN ('harbor map', 'projects index') THEN 'fixed-links'
    WHEN sa THEN CASE WHEN NOT t_beside THEN 'adr-source' END
    WHEN ta THEN CASE WHEN NOT s_beside THEN 'adr-target' END
    WHEN tp AND sn <> 'projects index' THEN CASE WHEN NOT sp THEN 'to-project' WHEN NOT (sn IN ('lantern project', 'tide tables') AND tn IN ('lantern project', 'tide tables')) THEN 'projects' END
  END AS rule, source, target FROM wide)
SELECT rule, source, target FROM judged WHERE rule <> 'to-project'
UNION ALL SELECT 'many-projects', source, NULL FROM judged WHERE rule = 'to-project' GROUP BY source HAVING count(*) > 1
UNION ALL SELECT 'unlisted', path, NULL FROM kinds WHERE adr AND path NOT IN (SELECT target FROM wide WHERE sarch AND s_beside)"""


@R.query(f"WITH {RULES_SQL}")
def rules_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.problems(notes(spark), rules=RULES)


@R.query(f"WITH {RULES_SQL.split('UNION ALL', 1)[0]} AND source = 'Life/Fixed Page.md'")
def rules_one_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.problems(notes(spark), only="Life/Fixed Page.md", rules=RULES)


@R.query(
    """WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_partkey <> l_suppkey),
ends AS (SELECT p AS node FROM e UNION ALL SELECT s FROM e), n AS (SELECT node, count(*) AS n FROM ends GROUP BY node)
SELECT p_partkey AS node, coalesce(n, 0)::BIGINT AS degree FROM part LEFT JOIN n ON node = p_partkey"""
)
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of order lines as edges."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("found")).filter("source <> found").distinct()
    return graph.degrees(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), pairs)


@R.query("SELECT DISTINCT l_partkey AS neighbour FROM lineitem WHERE l_suppkey = 7 UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 7")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("found"))
    return graph.neighbours(pairs, 7)


@R.query(
    f"""WITH {NOTES.sql()}, t AS (SELECT path, unnest(regexp_extract_all({NO_CODE}, '(?:^|\\s)#([A-Za-z][A-Za-z0-9_/-]*)', 1)) AS tag FROM notes)
SELECT path, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t GROUP BY path"""
)
def inline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = notes(spark).select("path", T.inline_tags(F.col("body")).alias("tags"))
    return own.filter(F.size("tags") > 0).withColumn("tags", F.array_join("tags", ","))


@R.query(
    f"""WITH {NOTES.sql()},
l AS (SELECT path, unnest(string_split(regexp_replace({NO_CODE}, '!?\\[\\[(?:[^\\]\\n]*\\|)?([^\\]\\n|]*)\\]\\]', '\\1', 'g'), chr(10))) AS line, unnest(range(0, len(string_split({NO_CODE}, chr(10))))) AS n FROM notes),
s AS (SELECT path, n, trim(regexp_replace(line, '^[#>\\-*\\s]+|\\*\\*|__|[*_`]', '', 'g')) AS line FROM l),
j AS (SELECT path, coalesce(string_agg(line, ' ' ORDER BY n) FILTER (line <> ''), '') AS text FROM s GROUP BY path)
SELECT path, CASE WHEN length(text) > 240 THEN rtrim(substr(text, 1, 240)) || '…' ELSE text END AS excerpt FROM j"""
)
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark).select("path", T.excerpt(F.coalesce("body", F.lit(""))).alias("excerpt"))


TAGS = Literal("raw", "note_id int, tag string", [(1, "#Machine Learning"), (1, "machine_learning"), (1, "C++!"), (2, "  Deep--Work "), (2, "#"), (3, "speech/TTS"), (3, "-a-"), (4, "plan"), (4, "Machine  Learning")])
TAG_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(tag), '^#+', '')), '[\\s_]+', '-', 'g'), '[^a-z0-9/-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g')"


@R.query(f"WITH {TAGS.sql()} SELECT note_id, tag, {TAG_SQL} AS normalised FROM raw")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAGS.df(spark).withColumn("normalised", T.tag_normalised(F.col("tag")))


@R.query(f"WITH {TAGS.sql()} SELECT {TAG_SQL} AS tag, count(*)::BIGINT AS notes FROM raw WHERE {TAG_SQL} <> '' GROUP BY 1")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.histogram(TAGS.df(spark).groupBy("note_id").agg(F.collect_list("tag").alias("tags")))


@R.query(
    "WITH w AS (SELECT doc_id AS note_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM documents), t(tag) AS (VALUES ('apache-license'), ('public-license'), ('the-and'), ('nowhere-word')) SELECT note_id, tag FROM w, t WHERE list_has_all(words, string_split(tag, '-'))"
)
def tag_words_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("apache-license",), ("public-license",), ("the-and",), ("nowhere-word",)], "tag string")
    return tags.words_fit(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text"), known)


@R.query()
def tag_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("postgresql",), ("machine-learnin",), ("kubernetes",)], "tag string")
    known = spark.createDataFrame([(1, "postgres"), (2, "machine-learning"), (3, "cooking"), (4, "plan")], "nth int, similar string")
    return tags.alike_by_spelling(wanted, known)


@R.query(
    """WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
p AS (SELECT w.vec_id AS tag, 'tag-' || k.label AS "similar", round(list_cosine_similarity(w.v, x.v), 6) AS score FROM w, k JOIN w x ON x.vec_id = k.vec_id WHERE w.vec_id::VARCHAR <> 'tag-' || k.label)
SELECT tag::VARCHAR AS tag, "similar", score FROM p QUALIFY row_number() OVER (PARTITION BY p.tag ORDER BY score DESC, "similar" DESC) = 1 AND score >= 0.68"""
)
def tag_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's first vector stands for a known tag (ten of them), every vector for a wanted one."""
    vectors = table(spark, sf_dir, "embeddings")
    known = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("known_vector")).select(F.concat(F.lit("tag-"), F.col("label").cast("string")).alias("similar"), "known_vector")
    return tags.alike_by_meaning(vectors.select(F.col("vec_id").cast("string").alias("tag"), F.col("embedding").alias("vector")), known)


@R.query(
    """WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
p AS (SELECT w.vec_id AS note_id, 'tag-' || k.label AS tag, round(list_cosine_similarity(w.v, x.v), 6) AS score FROM w, k JOIN w x ON x.vec_id = k.vec_id)
SELECT note_id, tag, score FROM p QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, tag DESC) <= 3 AND score >= 0.60"""
)
def tag_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    known = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("known_vector")).select(F.concat(F.lit("tag-"), F.col("label").cast("string")).alias("similar"), "known_vector")
    return tags.suggested(vectors.select(F.col("vec_id").alias("note_id"), F.col("embedding").alias("vector")), known)


TITLES = Literal("titles", "title string", [("../../.ssh/id_rsa",), ("..",), ("a:b*c?",), ("  spaced   out  ",), ("x" * 100,), ("",), ("tab\there",), (".hidden.",), ("Plain title",)])


@R.query(
    f"""WITH {TITLES.sql()}, c AS (SELECT title, regexp_replace(substr(regexp_replace(regexp_replace(title, '[/\\\\:*?"<>|\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g'), 1, 80), '^[. ]+|[. ]+$', '', 'g') AS f FROM titles)
SELECT title, CASE WHEN f = '' THEN 'Untitled' ELSE f END AS filename FROM c"""
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TITLES.df(spark).select("title", T.safe_filename(F.col("title")).alias("filename"))


MARKDOWN = Literal(
    "bodies",
    "note_id int, body string",
    [
        (1, f"# One\n{FILLER}\n## Two\n{FILLER}\n### Three\n{FILLER}\n## Four\n{FILLER}"),
        (2, "start\n```sh\n# install it\n```\n- in a list\n  ~~~\n  # also code\n  ~~~\nend"),
        (3, "part one\n---\npart two\n***\npart three"),
        (4, "#### Deep first\ntext\n## Up\nmore\n\n\n# Top\n"),
        (5, "   \n\n"),
        (6, "no heading at all"),
        (7, "## A ##\nx\n#not a heading\ny\n- - -\nz"),
    ],
)
SECTIONS_SQL = f"""{MARKDOWN.sql()},
l AS (SELECT note_id, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS n FROM bodies),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER w AS fences FROM l WINDOW w AS (PARTITION BY note_id ORDER BY n)),
h AS (SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(line, '^(#{{1,6}})\\s+(.*)') THEN length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)', 1)) END AS level,
  fences % 2 = 0 AND regexp_matches(line, '^\\s*(---+|\\*\\*\\*+)\\s*$') AS rule, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)', 2)) AS title FROM f),
c AS (SELECT *, sum(CASE WHEN level IS NOT NULL OR rule THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY n) AS section FROM h),
parts AS (SELECT note_id, section, trim(string_agg(line, chr(10) ORDER BY n) FILTER (level IS NULL AND NOT rule), ' ' || chr(10)) AS text, min(n) AS first FROM c GROUP BY ALL),
heads AS (SELECT p.note_id, p.section, x.n, x.level, x.title FROM parts p JOIN c x ON x.note_id = p.note_id AND x.level IS NOT NULL AND x.section <= p.section),
alive AS (SELECT * FROM heads a WHERE NOT EXISTS (SELECT 1 FROM heads b WHERE b.note_id = a.note_id AND b.section = a.section AND b.n > a.n AND b.level <= a.level)),
paths AS (SELECT note_id, section, string_agg(title, ' › ' ORDER BY n) AS path FROM alive GROUP BY ALL)"""


@R.query(f"WITH {SECTIONS_SQL} SELECT note_id, section::BIGINT AS section, coalesce(path, '') AS path, text FROM parts LEFT JOIN paths USING (note_id, section) WHERE text <> ''")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(MARKDOWN.df(spark)).withColumn("path", F.array_join("path", " › "))


@R.query(
    f"""WITH {SECTIONS_SQL}
SELECT note_id, section::BIGINT AS section, 'Note' || coalesce(' › ' || path, '') || chr(10) || chr(10) || text AS full_text,
  coalesce(string_split(path, ' › ')[-1] || chr(10) || chr(10), '') || text AS section_text
FROM parts LEFT JOIN paths USING (note_id, section) WHERE text <> ''"""
)
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.sections(MARKDOWN.df(spark))
    args = (F.lit("Note"), F.col("path"), F.col("text"))
    return own.select("note_id", "section", T.embedding_text(*args, "full").alias("full_text"), T.embedding_text(*args, "section").alias("section_text"))


@R.query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks."""
    return chunking.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text"), body_col="text").select("note_id", "position", "text")


@R.query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, length(line) // 4 AS tokens FROM l)
SELECT doc_id, min(tokens)::INTEGER AS least, median(tokens) AS middle, max(tokens)::INTEGER AS most, count(*)::BIGINT AS chunks FROM s GROUP BY doc_id"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each document's lines, which the SQL states; ``chunk_sizes`` measures the chunks."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("tokens", T.tokens(F.col("line")))
    return parts.groupBy("doc_id").agg(F.min("tokens").alias("least"), F.median("tokens").alias("middle"), F.max("tokens").alias("most"), F.count(F.lit(1)).alias("chunks"))


@R.query()
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in tokens of each document's chunks, and over all chunks in the row whose ``over_all`` is true. Documents without text have no chunks and no row."""
    parts = chunk_text(spark, sf_dir).select(F.col("note_id").alias("doc_id"), T.tokens(F.col("text")).alias("tokens"))
    own = parts.rollup("doc_id").agg((F.grouping("doc_id") == 1).alias("over_all"), F.min("tokens").alias("least"), F.median("tokens").alias("middle"), F.max("tokens").alias("most"), F.count(F.lit(1)).alias("chunks"))
    return own.select("doc_id", "over_all", "least", "middle", "most", "chunks")


@R.query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
