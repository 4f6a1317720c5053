"""As many partitions as rows need, so that a task's memory doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task groups or joins, about.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """df of about so many rows dealt out by cols, where Spark's own number of partitions would leave more than ROWS to each."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *cols) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
