"""Deterministic order, sampling, chunks and splits.

"Random" order is that of md5(seed-id), which any engine can repeat; ties break by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def draw(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def shuffled(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """All rows in random order: a range-partitioned sort, not one task."""
    return df.orderBy(draw(seed, key), key)


def sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows without replacement: top n by random key, of which each task keeps at most n."""
    return df.orderBy(draw(seed, key), key).limit(n)


def sample_by(df: DataFrame, by: list[str], n: int, seed: int, key: str = "id") -> DataFrame:
    """At most n random rows of each group; the rank filter is pushed below the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(draw(seed, key), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def top(df: DataFrame, score: str, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(n)


def best(df: DataFrame, score: str, key: str = "id") -> DataFrame:
    """The row of the largest score, of equal ones that with the smallest key: one aggregation, no sort."""
    row = F.min_by(F.struct(*df.columns), F.struct((-F.col(score)).alias("s"), key))
    return df.where(F.col(score).isNotNull()).agg(row.alias("_row")).where("_row is not null").select("_row.*")


def cut(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)


def top_by(df: DataFrame, by: list[str], score: str, n: int, key: str = "id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.col(key)))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def numbered(df: DataFrame, order: list[str], column: str = "pos", buckets: int | None = None) -> DataFrame:
    """Gapless positions from 0 in a total order without one global window; ties are numbered in any order.

    The rows are range-partitioned into ``buckets`` (without them as many as the session shuffles into, of which adaptive
    execution joins small ones), sorted and written once, since the bounds of a range partition are drawn anew whenever it is computed. Positions are counted within a partition and start after the counts of
    those before, of which there are as many as partitions. Extra columns stay, whatever their names.
    """
    row = df.select(F.struct(*df.columns).alias("row"))
    by = [F.col("row")[c] for c in order]
    ranged = row.repartitionByRange(*([buckets] if buckets else []), *by).sortWithinPartitions(*by)
    # an id holds the partition in its upper bits and the row's place there in the lower 33
    at = materialize(ranged.select("row", F.monotonically_increasing_id().alias("at")), "ranged")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = at.select("row", part.alias("part"), place.alias("place")).join(F.broadcast(before), "part")
    kept = [F.col("row")[c].alias(c) for c in df.columns if c != column]
    return placed.select(*kept, (F.col("before") + F.col("place")).alias(column))


def chunks_of(pos: Column, size: int) -> Column:
    """Chunk number when every ``size`` rows make a chunk."""
    return F.floor(pos / size)


def chunks_into(pos: Column, rows: Column, parts: int) -> Column:
    """Chunk number when rows are cut into ``parts`` of ceil(rows / parts)."""
    return F.floor(pos / F.ceil(rows / parts))


def strides(pos: Column, n: int) -> Column:
    return pos % n


def shard_even(pos: Column, rows: Column, parts: int) -> Column:
    """Equal shards, the remainder in the last one."""
    return F.least(F.floor(pos / F.floor(rows / parts)), F.lit(parts - 1))


def numbered_by(df: DataFrame, by: list[str], order: list[str], column: str = "pos", size: str = "size", buckets: int | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in its group and the group's size.

    A group begins where its least global position is, so no window holds a whole group; the join to the groups
    is by null-safe equality and is split where one group is large.
    """
    placed = numbered(df, [*by, *order], "_global", buckets)
    groups = placed.groupBy(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(F.min("_global").alias("_first"), F.count("*").alias(size))
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    return placed.join(groups, same).withColumn(column, F.col("_global") - F.col("_first")).drop("_global", "_first", *[f"_by{i}" for i in range(len(by))])


def split_by_class(df: DataFrame, label: str, ratio: float, order: list[str], buckets: int | None = None) -> DataFrame:
    """``is_train``: of each class the first half-even-rounded share of rows in the given order."""
    n = numbered_by(df, [label], order, "_at", "_size", buckets)
    return n.withColumn("is_train", F.col("_at") < F.bround(F.col("_size") * F.lit(ratio))).drop("_at", "_size")


def class_numbers(df: DataFrame, by: str, column: str = "label") -> DataFrame:
    """``df`` with the number of each row's class, classes numbered from 0 in name order.

    There may be as many classes as rows, so Spark chooses the join by their size.
    """
    classes = numbered(df.select(by).distinct(), [by], column)
    return df.join(classes, by)


def folds(df: DataFrame, stem: str, held_out: int) -> DataFrame:
    """``fold``, ``label`` and ``is_train`` from names of the form fold-...-label."""
    fold = F.split_part(stem, F.lit("-"), F.lit(1)).cast("int")
    return df.withColumns({"fold": fold, "label": F.regexp_extract(stem, "-([^-]*)$", 1), "is_train": fold != held_out})


def merged_scores(parts: list[DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """The union of scored parts with the best score of each key, combined before the shuffle."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.max(score).alias(score))


def ranked_merge(parts: list[DataFrame], score: str, rest: list[str], keep_score: bool = False) -> DataFrame:
    """Scored parts as one table without repeated rows, best score first, then by the other columns; the score goes."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy(*rest).agg(F.max(score).alias(score)).orderBy(F.desc(score), *rest)
    return out if keep_score else out.drop(score)


def without_remainder(shards: DataFrame, key: str, parts: int) -> DataFrame:
    """Shards in name order, as many as ``parts`` divides; their number is counted first."""
    n = shards.count()
    return shards.orderBy(key).limit(n - n % parts)


def epoch_length(sizes: DataFrame, nodes: int, workers: int, batch: int) -> DataFrame:
    """Batches of an epoch when shards (pos, n) are dealt to nodes, then to their workers: the longest worker's."""
    worker = F.floor(F.col("pos") / nodes) % workers
    per = sizes.groupBy((F.col("pos") % nodes).alias("node"), worker.alias("worker")).agg(F.sum("n").alias("n"))
    return per.agg(F.max(F.ceil(F.col("n") / batch)).cast("bigint").alias("batches"))
