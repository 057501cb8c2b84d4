"""Stand-ins for media tables, built from the driver's tables, and the SQL that builds the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, ordering, pairing

#: The first half of an embedding is view a, the second view b; each has four layers of eight numbers.
LAYERS, WIDTH = 4, 8
NAMES = [f"{v}_layer{i}" for v in "ab" for i in range(LAYERS)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def features(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, clustering, vec): one row per vector and layer."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    cut = F.array(*[F.struct(F.lit(n).alias("clustering"), F.slice("embedding", i * WIDTH + 1, WIDTH).alias("vec")) for i, n in enumerate(NAMES)])
    return e.select("id", "label", F.explode(cut).alias("f")).select("id", "label", "f.clustering", F.col("f.vec").cast("array<double>").alias("vec"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, clustering, vec): whole vectors, as one clustering named all."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.lit("all").alias("clustering"), F.col("embedding").cast("array<double>").alias("vec"))


def label_centers(rows: DataFrame) -> DataFrame:
    """(clustering, k, center): the mean vector of each label, as deterministic centres."""
    each = rows.select("clustering", F.col("label").alias("k"), F.posexplode("vec").alias("pos", "x")).groupBy("clustering", "k", "pos").agg(F.avg("x").alias("c"))
    return each.groupBy("clustering", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda p: p.c).alias("center"))


def models(rows: DataFrame) -> dict[str, clustering.Model]:
    """Models of all clusterings, one aggregation; as many numbers as labels x dimensions."""
    found = label_centers(rows).orderBy("clustering", "k").collect()
    out = {}
    for name in sorted({r["clustering"] for r in found}):
        mine = [r["center"] for r in found if r["clustering"] == name]
        out[name] = clustering.Model(np.array(mine), np.ones(len(mine)))
    return out


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """(id, clustering, centroid, distance)."""
    rows = features(spark, d)
    return clustering.assign(rows.select("id", "clustering", "vec"), models(rows))


def wide(spark: SparkSession, d: str) -> DataFrame:
    """(id, a): the centroids of each vector, assigned without a shuffle."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = models(features(spark, d))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()).astype(float)
        cols = [found[n].distances(x[:, i * WIDTH : (i + 1) * WIDTH], False).argmin(1) for i, n in enumerate(NAMES)]
        return pd.Series(list(np.stack(cols, 1).astype(np.int32)))

    return e.select("id", nearest("embedding").alias("a"))


def views(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, va, vb): the two halves as doubles."""
    e = table(spark, d, "embeddings")
    half = lambda i: F.slice("embedding", i, 32).cast("array<double>")
    return e.select(F.col("vec_id").alias("id"), "label", half(1).alias("va"), half(33).alias("vb"))


def media(spark: SparkSession, d: str) -> DataFrame:
    """Documents as clips: shard, stem, file and segment."""
    n = F.col("doc_id")
    shard = F.format_string("shard-%06d", n % 7)
    stem = F.format_string("%s_%03d", F.substring(F.md5(n.cast("string")), 1, 11), n % 500)
    return table(spark, d, "documents").select("doc_id", "source", "n_chars", shard.alias("shard_name"), stem.alias("stem"), F.concat(stem, F.lit(".mp4")).alias("filename"))


MEDIA_SQL = """media as (select doc_id, source, n_chars, printf('shard-%06d', doc_id % 7) shard_name,
  printf('%s_%03d', md5(doc_id::varchar)[1:11], doc_id % 500) stem,
  printf('%s_%03d', md5(doc_id::varchar)[1:11], doc_id % 500) || '.mp4' filename from documents)"""

FEATURES_SQL = """features as (select vec_id id, label, (case when p <= 32 then 'a' else 'b' end) || '_layer' || (((p - 1) // 8) % 4) clustering,
  (p - 1) % 8 pos, embedding[p]::double x from (select *, unnest(generate_series(1, 64)) p from embeddings))"""
CENTERS_SQL = FEATURES_SQL + ", centers as (select clustering, label k, pos, avg(x) c from features group by all)"
ASSIGN_SQL = CENTERS_SQL + """, dist as (select f.id, f.clustering, c.k, sum((f.x - c.c) * (f.x - c.c)) d from features f join centers c using (clustering, pos) group by all),
 assigned as (select id, clustering, k, d from (select *, row_number() over (partition by id, clustering order by d, k) rn from dist) where rn = 1)"""
#: All pairs of clusterings in name order, numbered as combinations are.
PAIRS_SQL = "names as (select distinct clustering from features), pairs as (select row_number() over (order by x.clustering, y.clustering) - 1 pair, x.clustering c1, y.clustering c2 from names x join names y on x.clustering < y.clustering)"
CELLS_SQL = ASSIGN_SQL + ", " + PAIRS_SQL + """, cells as (select pair, x.k i, y.k j, count(*) n from pairs join assigned x on x.clustering = c1 join assigned y on y.clustering = c2 and y.id = x.id group by all),
 marg as (select *, sum(n) over (partition by pair, j) a, sum(n) over (partition by pair, i) b, sum(n) over (partition by pair) t from cells)"""
VIEWS_SQL = "vw as (select vec_id id, label, embedding[1:32]::double[] va, embedding[33:64]::double[] vb from embeddings)"

PAIRS = pairing.combination(NAMES)


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    return ordering.numbered(df, order)
