"""Shards as a stream: restartable processing and an online model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clustering import Model, gather, model_of, step
from ..sources.files import existing


def shards(spark: SparkSession, path: str, schema: StructType, files: int = 8) -> DataFrame:
    """New shard files of a folder, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Processes what has not been processed by earlier runs, then stops; finished files are never read again."""
    return work(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def distinct_clips(rows: DataFrame, time: str = "ts", delay: str = "1 hour", key: str = "id") -> DataFrame:
    """Each clip once, with state bounded by a watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def last_model(spark: SparkSession, path: str, before: int | None = None) -> Model | None:
    """The model written by the last micro-batch, or the last one before ``before``."""
    if not existing(spark, path):
        return None
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return None if last is None else model_of(rows.where(F.col("batch") == last), "count")


def online_model(rows: DataFrame, model: Model, path: str, checkpoint: str, vec: str = "vec", rate: float = 0.01) -> StreamingQuery:
    """Updates a k-means model with every micro-batch; batch n's model is written under its number,
    so a repeated batch overwrites the same one.

    Each batch goes on from the model that the one before has written, also after a restart; ``model`` is
    that of the very first.
    """
    spark = rows.sparkSession

    def update(batch: DataFrame, n: int) -> None:
        now = last_model(spark, path, n) or model
        sums, counts, _ = gather(batch, now, vec)
        m = step(now, sums, counts, rate)
        table = spark.createDataFrame([(k, c.tolist(), float(x)) for k, (c, x) in enumerate(zip(m.centers, m.counts, strict=True))], "k int, center array<double>, count double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, width: str, by: str, delay: str = "1 hour") -> DataFrame:
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
