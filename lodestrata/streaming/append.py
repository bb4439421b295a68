"""Appending rows to an archive as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.batching import BATCH, with_ordinal
from lodestrata.operators.stats import segment_stats


def append(rows: DataFrame, path: str, order: str, epoch: int, fields: list[str], size: int = BATCH) -> None:
    """Writes one increment under its own epoch, so that writing it again replaces it.

    Batches are numbered within the increment; epoch and batch_id together name a batch.
    """
    batched = with_ordinal(rows, order).withColumn("batch_id", F.floor(F.col("_ordinal") / size).cast("int"))
    batched.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}", compression="zstd")
    segment_stats(batched, fields).write.mode("overwrite").parquet(f"{path}/column_stats/epoch={epoch}")


def append_stream(stream: DataFrame, path: str, order: str, fields: list[str], checkpoint: str, size: int = BATCH) -> StreamingQuery:
    """Appends each micro-batch of a stream; after a failure the last one is written again under the same epoch."""
    return stream.writeStream.foreachBatch(lambda rows, epoch: append(rows, path, order, epoch, fields, size)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The data and the statistics of all increments."""
    return spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/column_stats")
