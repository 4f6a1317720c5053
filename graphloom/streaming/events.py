"""Edge event streams: batch replay, and the same as Structured Streaming with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(events: DataFrame) -> DataFrame:
    """Edges (u, v, w) left after events (seq, type, u, v, w) in order of seq: EDGE_ADDITION and EDGE_WEIGHT_UPDATE set, EDGE_WEIGHT_INCREMENT adds, EDGE_REMOVAL ends."""
    e = events.where("type LIKE 'EDGE%'")
    hard = F.col("type") != "EDGE_WEIGHT_INCREMENT"
    w = Window.partitionBy("u", "v").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(F.when(hard, F.col("seq"))).over(w)
    kept = e.withColumn("last", last).where("last IS NULL OR seq >= last")
    out = kept.groupBy("u", "v").agg(F.sum(F.when(F.col("type") == "EDGE_REMOVAL", 0.0).otherwise(F.col("w"))).alias("w"), F.max(F.when(F.col("seq") == F.col("last"), F.col("type"))).alias("t"), F.count_if(~hard).alias("more"))
    return out.where("t IS NULL OR t <> 'EDGE_REMOVAL' OR more > 0").select("u", "v", "w")


def edge_windows(events: DataFrame, time_col: str = "ts", window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(window start, u, v, n): edges per tumbling window; works on a stream (late rows beyond the watermark are left out) and on a table."""
    e = events.withWatermark(time_col, watermark) if events.isStreaming else events
    return e.groupBy(F.window(time_col, window).alias("win"), "u", "v").agg(F.count("*").alias("n")).select(F.col("win.start").alias("window_start"), "u", "v", "n")


def transitions(events: DataFrame, who: str, state: str, order: list[str]) -> DataFrame:
    """(src, dst, n): how often a state follows another for the same actor."""
    nxt = F.lead(state).over(Window.partitionBy(who).orderBy(*order))
    return events.select(F.col(state).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"))
