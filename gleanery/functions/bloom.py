"""A Bloom filter in blocks, made and asked with Spark's own bitmap functions.

A key falls into one block of 32,768 bits and sets ``PROBES`` of them. The filter is a small table, a row for each block.
Keys that were put in are always found; of others, some two in a hundred at ``BITS_A_KEY``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768
BITS_A_KEY, PROBES = 10, 5
#: The largest filter that is sent to all executors; with more keys than it holds there is none.
MOST_BYTES = 64 << 20


def _probe(key: str, k: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(BLOCK))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(-1)), F.lit(blocks)).cast("int")


def blocks_for(keys: int) -> int:
    return max(1, math.ceil(keys * BITS_A_KEY / BLOCK))


def fits(keys: int) -> bool:
    return blocks_for(keys) * BLOCK // 8 <= MOST_BYTES


def bloom(rows: DataFrame, key: str, keys: int) -> DataFrame:
    """(block, bits) of the keys of some rows, of which there are about ``keys``."""
    each = rows.select(_block(key, blocks_for(keys)).alias("block"), F.explode(F.array(*(_probe(key, k) for k in range(PROBES)))).alias("at"))
    return each.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def perhaps_in(rows: DataFrame, key: str, made: DataFrame, keys: int) -> DataFrame:
    """The rows whose key may be one that the filter was made of; ``keys`` is the number that it was made for."""
    held = rows.withColumn("_block", _block(key, blocks_for(keys))).join(F.broadcast(made.withColumnRenamed("block", "_block")), "_block")
    byte = lambda at: F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.lit(True)
    for k in range(PROBES):
        at = _probe(key, k)
        hit = hit & (byte(at).bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0)
    return held.filter(hit).drop("_block", "bits")
