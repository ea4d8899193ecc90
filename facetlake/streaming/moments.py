"""Running mean and covariance of a stream of points, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.measure import covariance, merged_covariance


def start(points: DataFrame, by: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's moments under ``folder``/batch=<id>, once however often a batch is repeated."""

    def save(batch: DataFrame, number: int) -> None:
        covariance(batch, by).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str, by: list[str]) -> DataFrame:
    """The moments of all points so far: the pooled moments of the batches."""
    return merged_covariance(spark.read.parquet(folder).drop("batch"), by)
