"""Running totals over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.shared import written

#: The bits of an id of ``monotonically_increasing_id`` that number a part's rows.
PART_BITS = 33


def totals_before(rows: DataFrame, order: list[str], amount: str, folder: str, name: str = "before") -> DataFrame:
    """The rows with the sum of ``amount`` over all rows before them by ``order``, which must be total; a null counts as 0.

    The rows are sorted by ranges and written to ``folder``. Each range's sum is taken, one number a range comes to the driver
    to be added up, and within a range the total runs on from there.
    """
    at = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), folder).withColumn("_part", F.shiftright("_at", PART_BITS))
    own = F.coalesce(F.col(amount), F.lit(0))
    sums = at.groupBy("_part").agg(F.sum(own).alias("sum")).orderBy("_part").collect()
    begins, total = [], 0
    for r in sums:
        begins.append((r["_part"], total))
        total += r["sum"]
    offsets = rows.sparkSession.createDataFrame(begins, f"_part long, _offset {'double' if isinstance(total, float) else 'long'}")
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = at.withColumn(name, F.coalesce(F.sum(own).over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
    return found.withColumn(name, F.col(name) + F.col("_offset")).drop("_at", "_part", "_offset")
