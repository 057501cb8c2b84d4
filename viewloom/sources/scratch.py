"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where the session names none, a local folder is set up, but only on a local master: on a cluster each
    executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='viewloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads survive lost executors.

    With ``by``, a column of few values, reads of one value open that value's files alone.
    """
    path = f"{shared_dir(df.sparkSession)}/viewloom-{uuid.uuid4().hex}/{name}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later step reads."""
    for df in tables:
        for root in {f[: m.end() - 1] for f in df.inputFiles() if (m := re.search("/viewloom-[0-9a-f]{32}/", f))}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)
