"""Keyword, vector and hybrid retrieval over documents and embeddings.

A document's source is its title (weight A), its text the body. Embeddings' labels are
items and vector ids their chunks.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import fusion, lexical, segments, vector
from gleanery.plans.registry import Registry
from gleanery.sources.shared import shared_folder
from gleanery.sources.tables import table

R = Registry()
#: A short fixed list of stop words.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

POSTINGS_SQL = f"""
tokens AS (
  SELECT doc_id AS entity_id, regexp_extract_all(lower(source), '[a-z0-9]+') AS head, regexp_extract_all(lower(text), '[a-z0-9]+') AS body FROM documents),
postings AS (
  SELECT * FROM (
    SELECT entity_id, unnest(head) AS lexeme, unnest(range(0, len(head))) AS pos, 1.0::DOUBLE AS w FROM tokens
    UNION ALL
    SELECT entity_id, unnest(body) AS lexeme, unnest(range(0, len(body))) + len(head) AS pos, 0.4::DOUBLE AS w FROM tokens)
  WHERE lexeme NOT IN ({STOP_SQL}))"""


def items(docs: DataFrame) -> DataFrame:
    """Documents as items: the source is the title, the text the body."""
    return docs.select(F.col("doc_id").alias("entity_id"), F.col("source").alias("title"), F.col("text").alias("body"), *(["file"] if "file" in docs.columns else []))


def index(spark: SparkSession, sf_dir: str, name: str = "lists", make: segments.Make = lambda own: lexical.lists(own, STOP)) -> DataFrame:
    """The documents' live postings; files that were added to the table or changed since the last call are indexed first."""
    at = md5(sf_dir.encode()).hexdigest()[:16]
    return segments.followed(segments.Segments(spark, f"{shared_folder(spark)}/{name}-{at}", make), table(spark, sf_dir, "documents"), items)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("entity_id"), F.col("vec_id").alias("position"), "embedding", F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that stands for a question; empty if the table lacks it."""
    found = table(spark, sf_dir, "embeddings").filter("vec_id = 0 AND embedding IS NOT NULL").select("embedding").first()
    return list(found[0]) if found else []


COSINE_SQL = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT label AS entity_id, vec_id AS position, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)"""


@R.query(f"WITH {COSINE_SQL} SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, position) = 1 ORDER BY score DESC, entity_id LIMIT 10")
def vector_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.best_chunks(chunks(spark, sf_dir), first_vector(spark, sf_dir), 10)


@R.query(f"WITH {COSINE_SQL} SELECT * FROM scored WHERE entity_id IN (1, 3, 5, 7) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, position) = 1")
def vector_best_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.best_chunks(chunks(spark, sf_dir), first_vector(spark, sf_dir), 4, items=[1, 3, 5, 7])


@R.query(
    f"""WITH {COSINE_SQL}, close AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, position) <= 3)
SELECT entity_id, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions, string_agg('chunk ' || position, '; ' ORDER BY position) AS texts FROM close GROUP BY entity_id"""
)
def top_chunks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vector.top_in_order(chunks(spark, sf_dir), first_vector(spark, sf_dir), 3)
    return top.select("entity_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), F.array_join("texts", "; ").alias("texts"))


@R.query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
best AS (SELECT label AS entity_id, vec_id FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, vec_id) <= 3)
SELECT entity_id, count(*)::BIGINT AS in_top FROM best GROUP BY entity_id"""
)
def top3_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each item's three best chunks there are, by one query: not the reference's measure, which ``top3_crowding_queries`` has."""
    close = vector.top_in_order(chunks(spark, sf_dir), first_vector(spark, sf_dir), 3)
    return close.select("entity_id", F.size("positions").cast("long").alias("in_top"))


@R.query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
best AS (SELECT q.vec_id AS query_id, c.label AS entity_id, round(max(list_cosine_similarity(c.v, q.v)), 6) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 GROUP BY ALL),
top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= 3)
SELECT entity_id, count(*)::BIGINT AS in_top FROM top GROUP BY entity_id"""
)
def top3_crowding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each item is in a query's overall top 3. Every vector whose id is divisible by 20 is a query, against all chunks, itself among them."""
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.crowding(chunks(spark, sf_dir), queries, 3)


WORDS = ("thing", "license", "token", "benchmark")
ANY_SQL = f"""{POSTINGS_SQL},
tf AS (SELECT entity_id, lexeme, sum(w) AS tf FROM postings WHERE lexeme IN ({", ".join(f"'{w}'" for w in WORDS)}) GROUP BY ALL),
any_hits AS (SELECT entity_id, round(sum(tf / (tf + 1.0)) / {len(WORDS)}, 6) AS rank FROM tf GROUP BY entity_id)"""


@R.query(f"WITH {ANY_SQL} SELECT entity_id, rank FROM any_hits ORDER BY rank DESC, entity_id LIMIT 20")
def kw_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.search(index(spark, sf_dir), " ".join(WORDS), STOP, "any"), 20)


@R.query(
    f"""WITH {POSTINGS_SQL},
hits AS (SELECT entity_id, sum(w) AS tf FROM postings WHERE starts_with(lexeme, 'thes') GROUP BY entity_id)
SELECT entity_id, round(tf / (tf + 1.0), 6) AS rank FROM hits ORDER BY rank DESC, entity_id LIMIT 20"""
)
def kw_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.search(index(spark, sf_dir), "thes", STOP, "prefix"), 20)


@R.query(
    f"""WITH {POSTINGS_SQL},
phrase AS (SELECT DISTINCT a.entity_id FROM postings a JOIN postings b ON a.entity_id = b.entity_id AND b.pos = a.pos + 1 WHERE a.lexeme = 'apache' AND b.lexeme = 'license'),
tf AS (SELECT entity_id, coalesce(sum(w) FILTER (lexeme = 'licensed'), 0) AS t0, coalesce(sum(w) FILTER (lexeme = 'apache'), 0) AS t1,
    coalesce(sum(w) FILTER (lexeme = 'license'), 0) AS t2, coalesce(sum(w) FILTER (lexeme = 'src0'), 0) AS neg, coalesce(sum(w) FILTER (starts_with(lexeme, 'under')), 0) AS p,
    coalesce(sum(w) FILTER (lexeme = 'under'), 0) AS t3
  FROM postings WHERE lexeme IN ('licensed', 'apache', 'license', 'src0') OR starts_with(lexeme, 'under') GROUP BY entity_id),
judged AS (SELECT tf.*, t0 > 0 AND ph.entity_id IS NOT NULL AND neg = 0 AND t3 > 0 AS holds FROM tf LEFT JOIN phrase ph USING (entity_id))
SELECT entity_id, round(greatest((t0 / (t0 + 1) + t1 / (t1 + 1) + t2 / (t2 + 1) + t3 / (t3 + 1)) / 4, p / (p + 1)), 6) AS rank
FROM judged WHERE holds OR p > 0 ORDER BY rank DESC, entity_id LIMIT 50"""
)
def kw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.search(index(spark, sf_dir), 'licensed "apache license" -src0 under', STOP), 50)


@R.query(
    f"""WITH {POSTINGS_SQL},
phrase AS (SELECT DISTINCT a.entity_id FROM postings a JOIN postings b ON a.entity_id = b.entity_id AND b.pos = a.pos + 1 WHERE a.lexeme = 'apache' AND b.lexeme = 'license'),
tf AS (SELECT entity_id, coalesce(sum(w) FILTER (lexeme = 'apache'), 0) AS t1, coalesce(sum(w) FILTER (lexeme = 'license'), 0) AS t2,
    coalesce(sum(w) FILTER (lexeme = 'gnu'), 0) AS t3, coalesce(sum(w) FILTER (lexeme = 'src0'), 0) AS neg
  FROM postings WHERE lexeme IN ('apache', 'license', 'gnu', 'src0') GROUP BY entity_id)
SELECT entity_id, round((t1 / (t1 + 1) + t2 / (t2 + 1) + t3 / (t3 + 1)) / 3, 6) AS rank
FROM tf LEFT JOIN phrase ph USING (entity_id) WHERE ph.entity_id IS NOT NULL OR (t3 > 0 AND neg = 0) ORDER BY rank DESC, entity_id LIMIT 50"""
)
def kw_all_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.search(index(spark, sf_dir), '"apache license" OR gnu -src0', STOP, strict=True), 50)


@R.query("SELECT doc_id, source FROM documents WHERE text ILIKE '%license%'")
def like_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("text").ilike("%license%")).select("doc_id", "source")


TF_SQL = f"""
words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
tf AS (SELECT item_id, term, count(*) AS tf FROM words WHERE length(term) > 2 AND term NOT IN ({STOP_SQL}) GROUP BY ALL)"""


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(lexical.lexemes(F.col("text"))).alias("term"))
    return words.filter((F.length("term") > 2) & ~F.col("term").isin(STOP)).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@R.query(f"WITH {TF_SQL} SELECT item_id, term, tf::BIGINT AS tf FROM tf")
def tf_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(spark, sf_dir)


@R.query(
    f"""WITH {TF_SQL}, norm AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM tf GROUP BY item_id),
dots AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.tf * y.tf) AS d FROM tf x JOIN tf y ON x.term = y.term AND x.item_id < y.item_id GROUP BY ALL)
SELECT a, b, round(d / (p.n * q.n), 6) AS cosine FROM dots JOIN norm p ON p.item_id = a JOIN norm q ON q.item_id = b"""
)
def doc_pairs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of benchmark items that share a term, through the terms."""
    tf = term_counts(spark, sf_dir)
    norm = tf.groupBy("item_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n"))
    x, y = tf.alias("x"), tf.alias("y")
    dots = x.join(y, (F.col("x.term") == F.col("y.term")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).agg(F.sum(F.col("x.tf") * F.col("y.tf")).alias("d"))
    both = dots.join(norm.withColumnsRenamed({"item_id": "a", "n": "na"}), "a").join(norm.withColumnsRenamed({"item_id": "b", "n": "nb"}), "b")
    return both.select("a", "b", F.round(F.col("d") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


@R.query(
    f"""WITH {TF_SQL}, norm AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM tf GROUP BY item_id),
dots AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.tf * y.tf) AS d FROM tf x JOIN tf y ON x.term = y.term AND x.item_id < y.item_id GROUP BY ALL)
SELECT a, b, round(d / (p.n * q.n), 6) AS cosine FROM dots JOIN norm p ON p.item_id = a JOIN norm q ON q.item_id = b WHERE round(d / (p.n * q.n), 6) >= 0.5"""
)
def doc_pairs_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of benchmark items with a cosine of 0.5 or more."""
    return vector.similar_pairs(term_counts(spark, sf_dir), 0.5)


LISTS_SQL = f"""{ANY_SQL},
kw AS (SELECT entity_id, row_number() OVER (ORDER BY rank DESC, entity_id) AS position FROM any_hits QUALIFY position <= 20),
{COSINE_SQL.strip()},
vec AS (SELECT position AS entity_id, row_number() OVER (ORDER BY score DESC, position) AS position FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, scored.position) <= 20),
parts AS (SELECT entity_id, 1.0 / (60 + position) AS part, 0 AS list, position FROM kw UNION ALL SELECT entity_id, 1.0 / (60 + position), 1, position FROM vec),
fused AS (SELECT entity_id, round(sum(part::DOUBLE), 9) AS score, min(list * 1000 + position) AS first FROM parts GROUP BY entity_id)"""


def ranked_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The 20 best documents by keywords, and the 20 best by the vector of the same number."""
    words = lexical.top(lexical.search(index(spark, sf_dir), " ".join(WORDS), STOP, "any"), 20)
    near = vector.scored(chunks(spark, sf_dir), first_vector(spark, sf_dir)).select(F.col("position").alias("entity_id"), "score").orderBy(F.desc("score"), "entity_id").limit(20)
    return [fusion.positioned(words, F.desc("rank"), F.col("entity_id")), fusion.positioned(near, F.desc("score"), F.col("entity_id"))]


@R.query(f"WITH {LISTS_SQL} SELECT entity_id, score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused(ranked_lists(spark, sf_dir)).select("entity_id", "score")


@R.query(f"WITH {LISTS_SQL}, best AS (SELECT * FROM fused ORDER BY score DESC, first LIMIT 10) SELECT entity_id, score, source, n_chars, lang FROM best JOIN documents ON doc_id = entity_id")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused, the ten best with what the index says of them; ids that it doesn't know drop out."""
    best = fusion.top_fused(ranked_lists(spark, sf_dir), 10)
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "source", "n_chars", "lang")
    return facts.join(F.broadcast(best), "entity_id").select("entity_id", "score", "source", "n_chars", "lang")


@R.query(
    f"""WITH {LISTS_SQL}, best AS (SELECT * FROM fused ORDER BY score DESC, first LIMIT 5),
paragraphs AS (SELECT b.entity_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS position FROM best b JOIN documents ON doc_id = entity_id),
picked AS (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY length(text) DESC, position) <= 3)
SELECT entity_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS sections FROM picked GROUP BY entity_id"""
)
def context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sections of each hit, the longest, in the order of the document."""
    best = fusion.top_fused(ranked_lists(spark, sf_dir), 5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    parts = docs.join(F.broadcast(best), "entity_id").select("entity_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    longest = Window.partitionBy("entity_id").orderBy(F.desc(F.length("text")), "position")
    picked = parts.withColumn("nth", F.row_number().over(longest)).filter("nth <= 3")
    return picked.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("p")).select("entity_id", F.array_join(F.col("p.text"), "\n\n").alias("sections"))


@R.query(
    f"""WITH {LISTS_SQL}, best AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, first) AS position FROM fused QUALIFY position <= 5),
blocks AS (SELECT position, '[' || position || '] ITEM — document ' || doc_id || '  (source: ' || source || ')' || chr(10) || '    date: 2024-01-' || lpad((1 + position)::VARCHAR, 2, '0') || ' 00:00' || chr(10) || '    ' || substr(text, 1, 500) AS block
  FROM best JOIN documents ON doc_id = entity_id)
SELECT string_agg(block, chr(10) || chr(10) ORDER BY position) AS context FROM blocks"""
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits with the excerpts that the index keeps, 500 characters; ``context_bodies`` has whole texts, ``context_whole_notes`` both."""
    best = fusion.fused(ranked_lists(spark, sf_dir)).orderBy(F.desc("score"), "first").limit(5)
    best = fusion.positioned(best, F.desc("score"), F.col("first"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "source", F.substring("text", 1, T.INDEX_EXCERPT_CHARS).alias("content"))
    hits = docs.join(F.broadcast(best), "entity_id").withColumn("modified_at", F.expr("timestamp '2024-01-01' + make_dt_interval(position)"))
    return fusion.rendered(hits)


@R.query(
    f"""WITH {LISTS_SQL}, best AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, first) AS position FROM fused QUALIFY position <= 5),
blocks AS (SELECT position, '[' || position || '] ITEM — document ' || doc_id || '  (source: ' || source || ')' || chr(10) || '    date: 2024-01-' || lpad((1 + position)::VARCHAR, 2, '0') || ' 00:00' || coalesce(chr(10) || '    ' || nullif(text, ''), '') AS block
  FROM best JOIN documents ON doc_id = entity_id)
SELECT coalesce(string_agg(block, chr(10) || chr(10) ORDER BY position), 'No results found in the user''s personal system.') AS context FROM blocks"""
)
def context_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits with their whole texts, as the bodies that the reference fetches. A null or empty text leaves its line out."""
    best = fusion.fused(ranked_lists(spark, sf_dir)).orderBy(F.desc("score"), "first").limit(5)
    best = fusion.positioned(best, F.desc("score"), F.col("first"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "source", F.col("text").alias("content"))
    hits = docs.join(F.broadcast(best), "entity_id").withColumn("modified_at", F.expr("timestamp '2024-01-01' + make_dt_interval(position)"))
    return fusion.rendered(hits)


@R.query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.functions.vectors import dot

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@R.query(f"WITH {COSINE_SQL} SELECT position AS vec_id, score FROM scored WHERE score >= 0.68")
def vectors_like_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vector.scored(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir))
    return own.select("vec_id", "score").filter("score >= 0.68")
