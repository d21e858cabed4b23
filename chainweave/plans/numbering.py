"""Consecutive numbers in sorted order without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.plans.lineage import cut


def numbered(df: DataFrame, order: Column | str | list, name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... by ``order`` (one key or a list): a distributed sort, then one offset per partition."""
    rows = cut(df.orderBy(*(order if isinstance(order, list) else [order])).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = parts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")).alias("_base"))
    return rows.join(base, "_part").withColumn(name, F.col("_base") + F.col("_row")).drop("_id", "_part", "_row", "_base")
