"""Structured Streaming: micro-batch ingest of turns, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scoring as R
from ..functions import text as X


def prepared(turns: DataFrame) -> DataFrame:
    """The columns that an insert computes; the same for a batch and a stream."""
    return turns.filter(F.trim(F.coalesce("content", F.lit(""))) != "").withColumns({"token_count": X.tokens_floor_chars(F.col("content")), "importance_score": F.round(R.turn_importance(F.col("content"), F.col("role")), 6)})


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 10) -> StreamingQuery:
    """Turns from Parquet files to a table, each micro-batch once: a batch's own folder is overwritten when it is tried again."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        prepared(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by type and window; ``late`` sets a watermark for a stream."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, as far back as the watermark reaches."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_facts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """A stream joined to the static facts of its user."""
    return events.join(facts.select(F.col("id").alias("user_id"), "category", "importance"), "user_id")
