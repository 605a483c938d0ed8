"""Streaming: responses scored as they arrive, failures counted by event-time window.

Scoring is per row, so the scorer is a stateless stream-static join; the windowed
counts carry a watermark, which bounds their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.verify import component_rows, verify


def score_stream(responses: DataFrame, tasks: DataFrame, **options) -> DataFrame:
    """Ledgers of a stream of responses against a static table of tasks; takes the options of ``verify``."""
    return verify(responses, tasks, **options)


def failure_counts(ledgers: DataFrame, time: str, width: str = "10 minutes", late: str = "30 minutes", threshold: float = 1.0) -> DataFrame:
    """Failing components by tumbling window; ``ledgers`` has the event time as a column."""
    rows = ledgers.withWatermark(time, late).select(time, F.inline_outer("components")).where(F.col("score") < threshold)
    return rows.groupBy(F.window(time, width), "component_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def write_clusters(ledgers: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each micro-batch's component summary to Parquet, once per batch id."""

    def batch(df: DataFrame, number: int) -> None:
        component_rows(df).groupBy("component_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ledgers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
