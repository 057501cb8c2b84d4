"""Readers of metadata, keyword lists, shard files and run logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


#: Field names of the metadata format, which are fixed values.
METADATA = T.StructType([
    T.StructField("MediaVersionList", T.ArrayType(_strings("Title", "Duration", "Height", "Width", "FileSize", "VideoCodec", "AudioCodec", "MediaBlobURL", "Timestamp"))),
    T.StructField("LatestDAFeature", _strings("Title", "Description", "ThumbnailURL", "PubDate", "VideoLength", "YouTubeCategory")),
])
SHARD_METADATA = T.ArrayType(T.StructType([T.StructField("filename", _S), T.StructField("id", _S), T.StructField("segment", T.ArrayType(T.DoubleType()))]))
RUN_LOG = T.StructType([T.StructField("hostname", _S), T.StructField("pid", T.LongType()), T.StructField("timestamp", _S), T.StructField("time", _S), T.StructField("shards", T.ArrayType(_S))])


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(url, json, meta) of a two-column tab-separated file; lines of another shape are dropped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.size(parts) == 2)
    return lines.select(parts[0].alias("url"), parts[1].alias("json"), F.from_json(parts[1], METADATA).alias("meta"))


def metadata_columns(rows: DataFrame) -> DataFrame:
    """Title, description, category and length in seconds; numbers come as text."""
    m = F.col("meta.LatestDAFeature")
    return rows.select("url", m.Title.alias("title"), m.Description.alias("description"), m.YouTubeCategory.alias("category"), m.VideoLength.try_cast("double").alias("length"), F.timestamp_seconds(m.PubDate.try_cast("bigint")).alias("published"))


def keywords(spark: SparkSession, path: str, columns: int = 8) -> DataFrame:
    """Distinct phrases, as arrays of tokens, of headed CSV files with ragged rows."""
    names = [f"t{i}" for i in range(columns)]
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names), enforceSchema=True, mode="PERMISSIVE")
    phrase = F.filter(F.transform(F.array(*names), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return rows.select(phrase.alias("phrase")).where(F.size("phrase") > 0).distinct()


def expand(pattern: str) -> list[str]:
    """Brace patterns as a list: {a,b} and numeric {000..010}, padded as the first number is."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    span = re.fullmatch(r"(\d+)\.\.(\d+)", m[1])
    parts = [str(i).zfill(len(span[1])) for i in range(int(span[1]), int(span[2]) + 1)] if span else m[1].split(",")
    return [x for p in parts for x in expand(pattern[: m.start()] + p + pattern[m.end() :])]


def listing(spark: SparkSession, path: str, glob: str = "*.mp4") -> DataFrame:
    """(path, length) of files below a folder, without names of several dots or parents named clips_*."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.where((F.length(name) - F.length(F.replace(name, F.lit("."))) <= 1) & ~F.col("path").rlike(r"/clips_[^/]*/[^/]*$"))


def shard_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shard_name, stem, filename, id, segment, shard_size) of JSON files with one array each; absent files give no rows."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("shard_name"), F.from_json("value", SHARD_METADATA).alias("rows"))
    each = text.select("shard_name", F.size("rows").alias("shard_size"), F.explode("rows").alias("r")).select("shard_name", "shard_size", "r.*")
    return each.withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs with their partition number: their place among the files in name order."""
    from pyspark.sql import Window as W

    logs = spark.read.schema(RUN_LOG).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    return logs.withColumn("partition", F.dense_rank().over(W.orderBy("_file")) - 1).drop("_file")


def features(spark: SparkSession, path: str) -> DataFrame:
    """Feature or assignment shards; damaged files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "false").parquet(path)


def _clips(rows: DataFrame, clips: int) -> DataFrame:
    return rows.withColumn("clip", F.explode(F.sequence(F.lit(0), F.lit(clips - 1))))


def split_lists(spark: SparkSession, folder: str, mode: str, split: int, clips: int = 1) -> DataFrame:
    """(path, label, clip) of a list file ``splits/{mode}list{split}.txt`` of paths below class folders; ``val`` is
    ``test``. Classes are numbered from 1 in ``splits/classInd.txt``; a class that it lacks is an error."""
    mode = "test" if mode == "val" else mode
    fields = F.split(F.trim("value"), r"\s+")
    classes = spark.read.text(f"{folder}/splits/classInd.txt").where(F.trim("value") != "").select(F.get(fields, F.lit(1)).alias("class"), (F.get(fields, F.lit(0)).cast("int") - 1).alias("label"))
    listed = spark.read.text(f"{folder}/splits/{mode}list{split:02d}.txt").where(F.trim("value") != "").select(F.get(fields, F.lit(0)).alias("path"))
    joined = listed.withColumn("class", F.split_part("path", F.lit("/"), F.lit(1))).join(classes, "class", "left")
    label = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no such class: "), "class")).cast("int")).otherwise(F.col("label"))
    return _clips(joined.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), label.alias("label")), clips)


def fold_files(spark: SparkSession, folder: str, mode: str, fold: int, clips: int = 1, glob: str = "*.wav") -> DataFrame:
    """(path, label, clip) of files named fold-...-label; ``train`` has all folds but one, other modes have that one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{folder}/audio").select("path")
    stem = F.split_part(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("."), F.lit(1))
    own = F.split_part(stem, F.lit("-"), F.lit(1)).cast("int")
    return _clips(found.where(own != fold if mode == "train" else own == fold).select("path", F.regexp_extract(stem, "([^-]*)$", 1).cast("int").alias("label")), clips)


def labelled_folders(spark: SparkSession, folder: str, mode: str, clips: int = 1, glob: str = "*.mp4") -> DataFrame:
    """(path, label, clip) of files below ``folder/mode/class``; classes are numbered from 0 in name order."""
    from ..operators.ordering import class_numbers

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(f"{folder}/{mode}").select("path")
    named = found.withColumn("class", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    return _clips(class_numbers(named, "class").select("path", F.col("label").cast("int").alias("label")), clips)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a list of addresses or names, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line") != "")


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, address) of a table of models in Markdown: the first column, and the first link of the row."""
    cells = F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|")
    link = F.regexp_extract("value", r"\]\(([^)\s]+)\)", 1)
    return spark.read.text(path).where(link != "").select(F.trim(F.get(cells, F.lit(0))).alias("name"), link.alias("address"))


def existing(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at)
