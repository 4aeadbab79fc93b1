"""Structured Streaming: stored responses as they arrive, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions.scope import ScopeRules
from webloom.operators.build import RESPONSES, build_graph
from webloom.sources.store import Store


def stream_responses(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Responses from Parquet files that appear under a path."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest_crawls(responses: DataFrame, store: Store, rules: ScopeRules, target: str, checkpoint: str) -> StreamingQuery:
    """Save each micro-batch as a crawl of its own. A batch that is run again, or by two queries at once, is saved once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        g = build_graph(batch, rules)
        store.save(g.nodes, g.edges, g.findings, target, f"batch-{batch_id}", once=f"{target} batch-{batch_id}")

    return responses.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, key_col: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n) by event time, for streams and tables; rows later than the watermark are dropped by a stream."""
    counted = events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n")
