"""Tables of a folder of Parquet files, and literal tables for both Spark and SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Literal:
    """A small table given row by row, readable by Spark and writable as SQL."""

    def __init__(self, name: str, schema: str, rows: Sequence[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, list(rows)

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """``name AS (...)`` for a WITH clause."""
        columns = [c.strip().split(" ", 1) for c in self.schema.split(",")] if "<" not in self.schema else [c.split(" ", 1) for c in _split(self.schema)]
        kinds = [_sql_type(kind.strip()) for _, kind in columns]
        rows = ", ".join("(" + ", ".join(f"CAST({_sql_value(v)} AS {k})" for v, k in zip(row, kinds, strict=True)) + ")" for row in self.rows)
        return f"{self.name}({', '.join(n for n, _ in columns)}) AS (VALUES {rows})"


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def _sql_type(kind: str) -> str:
    if kind.startswith("array<"):
        return _sql_type(kind[6:-1]) + "[]"
    return {"string": "VARCHAR", "long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}[kind]


def _sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list | tuple):
        return "[" + ", ".join(_sql_value(x) for x in v) + "]"
    if isinstance(v, int | float):
        return repr(v)
    text = str(v).replace("'", "''")
    for c in ("\n", "\t", "\r", "\x1c"):
        text = text.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{text}')"
