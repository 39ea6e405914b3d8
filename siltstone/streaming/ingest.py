"""Chunks that arrive as files, upserted batch by batch (an extension of the batch tools)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.store import CHUNKS, VersionedTable


def upsert_stream(spark: SparkSession, folder: str, table: VersionedTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert JSON lines as they arrive; a batch that is repeated after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.where("chunk_id is not null and company is not null and text is not null")
        table.upsert(rows.withColumn("arrival", F.lit(number + 1)))

    stream = spark.readStream.schema(CHUNKS).json(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def counts_stream(spark: SparkSession, folder: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by type in windows of event time, with a watermark for late ones."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return events.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
