"""Exact deduplication as a stateful stream.

Texts are equal when they are identical without white space. A stream reads one small
row for each text: the SHA-256 of the text without white space, its length, its id and
its content's locator, the file and row number that it stands at (a table that comes
from no files is written to some first). Its state is keyed by digest, kept on disk by
RocksDB and never expires; it holds the number of copies and the identifier and locator
of the row that stays: the longest original text, then the smallest id (a null id last),
then the first row. A stream that is given more rows later goes on from the same state.

Equal digests aren't taken for equal texts. Hits, rows whose digest was met more than
once, are compared by their full bytes with the text that stays, which is fetched by its
locator; texts that were met once don't move. Should a hit's bytes ever differ, its
digest's rows are grouped by the texts themselves. Copies meet in sums made before the
shuffle, so one text may have any share of all rows.

All of it is DataFrame operations. Null texts count as empty and empty texts are equal
to each other; an empty table gives no rows; of repeated rows one stays.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, materialize, shared_folder

#: Rows of a side that is sent to all executors, some 50 bytes each; a larger one is joined by a shuffle.
SMALL = 1 << 20
SPACE = (" ", "\t", "\n", "\v", "\f", "\r")
ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
#: Stores are many and may be small, so none allocates disk ahead of its need (some 4 MB each).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{ROCKSDB}.boundedMemoryUsage": "true",
    f"{ROCKSDB}.maxMemoryUsageMB": "128",
    f"{ROCKSDB}.allowFAllocate": "false",
}


def without_space(text: Column) -> Column:
    for c in SPACE:
        text = F.replace(text, F.lit(c))
    return text


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows with all their columns and two more, which say what file (its path's hash) and row each stands at; and those columns' names."""
    file, row = fresh(docs, "at_file", "at_row")

    def found(df: DataFrame) -> DataFrame:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))

    try:
        return found(docs), file, row
    except AnalysisException:  # not straight from files
        return found(materialize(docs, "documents")), file, row


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, file, file_row); a null text is the empty text."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return located(own)[0].withColumnsRenamed({"at_file": "file", "at_row": "file_row"})


def digest_rows(texts: DataFrame) -> DataFrame:
    """(digest, n_chars, doc_id, row, file, file_row) of every row (doc_id, text, file, file_row)."""
    return texts.select(F.sha2(without_space(F.col("text")), 256).alias("digest"), F.char_length("text").cast("long").alias("n_chars"), "doc_id", F.monotonically_increasing_id().alias("row"), "file", "file_row")


def sent(side: DataFrame, rows: int) -> DataFrame:
    """The side of a join, broadcast if it is known to be small."""
    return F.broadcast(side) if rows <= SMALL else side


def first_choice() -> Column:
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "file", "file_row"))


def grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, group_size, keep) of digest rows, streaming or not."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), first_choice().alias("keep"))


def run_stream(spark: SparkSession, source: str, schema, folder: str) -> DataFrame:
    """Feeds the digest rows in a folder of Parquet files to the state under ``folder``; gives the groups as they now are.

    Called again after files were added, it reads only those.
    """
    held = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            grouped(stream, "digest")
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(grouped(spark.createDataFrame([], schema), "digest").schema.add("batch", "long")).parquet(f"{folder}/groups")
    newest = F.max_by(F.struct("group_size", "keep"), "batch").alias("g")
    return changes.groupBy("digest").agg(newest).select("digest", "g.group_size", "g.keep")


def clashes(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests under which a hit's bytes differ from those of the text that stays; of texts (doc_id, text, file, file_row) and their groups."""
    met = materialize(groups.filter("group_size > 1").select("digest", F.xxhash64("digest").alias("key"), "keep.file", "keep.file_row"), "met-again")
    n = met.count()
    hashed = texts.select(F.sha2(without_space(F.col("text")), 256).alias("digest"), without_space(F.col("text")).alias("body"))
    hits = hashed.withColumn("key", F.xxhash64("digest")).join(sent(met.select("key").distinct(), n), "key", "left_semi").groupBy("digest", "body").agg(F.lit(1).alias("one"))
    keepers = texts.join(sent(met.select("digest", "file", "file_row"), n), ["file", "file_row"]).select("digest", without_space(F.col("text")).alias("kept_body"))
    return hits.join(keepers, "digest").filter(F.col("body") != F.col("kept_body")).select("digest").distinct()


def _judged(texts: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars, file, file_row) of every row (doc_id, text, file, file_row)."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    rows = digest_rows(texts)
    rows.write.parquet(f"{folder}/rows")
    staged = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    groups = materialize(run_stream(spark, f"{folder}/rows", rows.schema, folder), "groups")
    odd = materialize(clashes(texts, groups), "clashes")
    result = placed(staged, groups, "digest")
    return result if odd.isEmpty() else resolved(texts, result, odd)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars) of every row."""
    return _judged(plain(docs, id_col, text_col)).drop("file", "file_row")


def placed(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    found = rows.join(groups, list(keys))
    kept = F.col("keep.row") == F.col("row")
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "n_chars", "file", "file_row")


def resolved(texts: DataFrame, result: DataFrame, odd: DataFrame) -> DataFrame:
    """The result with the rows of clashing digests grouped by their texts instead."""
    body = without_space(F.col("text"))
    own = digest_rows(texts).drop("row").join(odd, "digest", "left_semi").join(texts.select("file", "file_row", body.alias("body")), ["file", "file_row"])
    again = materialize(own.withColumn("row", F.monotonically_increasing_id()), "clash-rows")
    fine = result.join(odd.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").select(*result.columns)
    return fine.unionByName(placed(again, grouped(again, "digest", "body"), "digest", "body"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; the others are found by their locators."""
    whole, file, row = located(docs)
    texts = whole.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(file).alias("file"), F.col(row).alias("file_row"))
    gone = materialize(_judged(texts).filter(~F.col("kept")).select(F.col("file").alias(file), F.col("file_row").alias(row)), "exact-copies")
    return whole.join(sent(gone, gone.count()), [file, row], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
