"""Writers of selections, shards, models and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import segment_text

SELECTION = ["shard_name", "filename", "id", "segment"]


def write_selection(rows: DataFrame, path: str, order: list[str], mode: str = "append") -> None:
    """The selection file: no header, CRLF line ends, segment as a quoted list, rows in order."""
    text = rows.orderBy(*order).select("shard_name", "filename", "id", segment_text(F.col("segment")).alias("segment"))
    text.write.mode(mode).option("lineSep", "\r\n").option("header", "false").csv(path)


def read_selection(spark: SparkSession, path: str, scored: bool = False) -> DataFrame:
    names = (["score double"] if scored else []) + [f"{c} string" for c in SELECTION]
    return spark.read.schema(", ".join(names)).option("lineSep", "\r\n").csv(path)


def merge_selections(spark: SparkSession, path: str) -> DataFrame:
    """Part files of several runs with the run that each row's file names before its last underscore."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)_[^/_]*$", 1)
    return read_selection(spark, path).withColumn("run", run)


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard; only the shards in ``rows`` are replaced."""
    rows.repartition("shard_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_name").parquet(path)


def write_log(spark: SparkSession, path: str, host: str, pid: int, stamp: str, time: str, shards: list[str]) -> None:
    row = spark.createDataFrame([(host, pid, stamp, time, shards)], "hostname string, pid long, timestamp string, time string, shards array<string>")
    row.coalesce(1).write.mode("append").json(path)


def write_experiment(rows: DataFrame, path: str, keys: list[str]) -> None:
    rows.write.mode("append").partitionBy(*keys).parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def write_model(spark: SparkSession, model, path: str, epoch: int, shards: list[str]) -> None:
    """A model's centres under its epoch and the shards that it has seen; an epoch written again is replaced."""
    rows = [(epoch, sorted(shards), k, c.tolist(), float(n)) for k, (c, n) in enumerate(zip(model.centers, model.counts, strict=True))]
    table = spark.createDataFrame(rows, "epoch int, shards array<string>, k int, center array<double>, count double")
    table.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def read_model(spark: SparkSession, path: str, shards: list[str], subset: bool = True):
    """The model of the latest epoch whose shards lie within (or cover) the wanted ones, or None."""
    from ..operators.clustering import model_of
    from ..operators.records import covering_models

    found = covering_models(spark.read.parquet(path), shards, subset)
    last = found.agg(F.max("epoch")).first()[0]
    return None if last is None else model_of(found.where(F.col("epoch") == last), "count")


def write_chunk(rows: DataFrame, path: str, chunk: int) -> None:
    """One chunk's results; a chunk that is run again replaces its own."""
    rows.withColumn("chunk", F.lit(chunk)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def unfinished_chunks(spark: SparkSession, path: str, chunks: int) -> list[int]:
    """The chunks without results so far."""
    from .files import existing

    done = {r[0] for r in spark.read.parquet(path).select("chunk").distinct().collect()} if existing(spark, path) else set()
    return [c for c in range(chunks) if c not in done]


def reduce_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks' results as one table, without the chunk."""
    return spark.read.parquet(path).drop("chunk")
