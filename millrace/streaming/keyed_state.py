"""Streams into keyed vector state: each micro-batch is one summed, versioned update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import updates
from millrace.operators.updates import Optimizer


def apply_gradients(stream: DataFrame, path: str, optimizer: Optimizer, dim: int, checkpoint: str, keep: int = 3):
    """Starts a query that applies each micro-batch of gradients (id, vec) to the newest version under path.

    The version written is the batch's number plus one, so a batch that runs again after
    a failure writes the same version again.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in updates.versions(spark, path) if v <= number]
        table = updates.restore(spark, path, 1, before[-1]).drop("shard")
        updates.save(updates.step(table, batch, optimizer, dim, at=number + 1), path, number + 1, keep=keep)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """An extension: counts in tumbling event-time windows; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
