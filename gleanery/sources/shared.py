"""Where jobs put tables that all executors must see."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. One of our own only where none is named and all run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return (named or "/tmp/checkpoints/gleanery").rstrip("/")


def written(rows: DataFrame, folder: str) -> DataFrame:
    """The rows, written under a name of their own and read back: what was computed once isn't computed again."""
    path = f"{folder}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
