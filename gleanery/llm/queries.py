"""The corpus operators as queries over the table ``documents``, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import align, best_fit, exact, fingerprints, lines, media, merkle, near, pii, spm, suffix, token_counts, toxicity
from gleanery.llm.common import documents, materialize

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicated(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS size, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, size::BIGINT AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encoded(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), budget=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_within")


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = materialize(media.store(documents(spark, sf_dir)), "media", compression="zstd")  # what is read back has been written
    return media.inspect(held)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
WITH chars AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS space),
split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents),
keyed AS (SELECT doc_id, n, line, translate(trim(line, space), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split, chars),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, n, line, coalesce(doc_id <> last, false) AS dropped FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    rows = merkle.manifest(documents(spark, sf_dir), claimed={"text": changed})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MERKLE_SQL = """
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
marked AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered,
  coalesce('=' || source, '') AS tree FROM documents, crc_table),
fields AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claim FROM marked),
hashed AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claim) || ':' || claim, '-')) AS claimed FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
low(tree, level, pos, n, node) AS (SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subroots AS (SELECT tree, level AS top, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, node) AS (SELECT 0, pos, n, node FROM subroots
  UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
low_kin AS (SELECT tree, level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM low WHERE n > 1),
high_kin AS (SELECT level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM high WHERE n > 1),
low_walk(tree, k, level, pos, node, proof) AS (SELECT tree, pos, 0, pos, claimed, '' FROM leaves
  UNION ALL SELECT w.tree, k, w.level + 1, w.pos // 16, sha256(before || node || behind), proof || before || behind FROM low_walk w JOIN low_kin b ON b.tree = w.tree AND b.level = w.level AND b.pos = w.pos),
high_walk(tree, k, level, pos, node, proof) AS (SELECT w.tree, k, 0, s.pos, w.node, proof FROM low_walk w JOIN subroots s ON s.tree = w.tree AND s.top = w.level
  UNION ALL SELECT tree, k, w.level + 1, w.pos // 16, sha256(before || node || behind), proof || before || behind FROM high_walk w JOIN high_kin b ON b.level = w.level AND b.pos = w.pos)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.node AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN high_walk w ON w.tree = l.tree AND w.k = l.pos JOIN high r ON r.n = 1 AND r.level = w.level
"""


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_suffix_dedup, op4_exact_dedup, op5_minhash_near_dedup, op6_pii, op7_sentencepiece, op8_token_counts, op9_progressive_jpeg, op10_line_dedup, op11_cross_tokenizer_alignment, op12_merkle_manifest, op13_document_fingerprints)}
ORACLES: dict[str, str] = {"op4_exact_dedup": EXACT_DEDUP_SQL, "op10_line_dedup": LINE_DEDUP_SQL, "op12_merkle_manifest": MERKLE_SQL}
