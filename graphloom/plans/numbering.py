"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import materialize


def numbered(df: DataFrame, *order: str | Column, name: str = "number", first: int = 0) -> DataFrame:
    """df with numbers from first in the given order: range partitions are sorted, and each adds the rows of those before it."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "numbered").withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_k"))  # one row per partition
    before = F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base")))
    return rows.join(base, "_part").withColumn(name, F.col("_base") + F.col("_in") + first).drop("_at", "_part", "_in", "_base")
