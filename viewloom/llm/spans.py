"""Finding runs that occur more than once in a corpus.

The rows given here are occurrences: a 128-bit hash of what the run says, the document and the place.
The first occurrence is that with the smallest (document, place); all others are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: An occurrence: hash, document id, hash of its text (rows that repeat a document count as one), place.
OCCURRENCE = ["h1", "h2", "id", "tx", "pos"]


#: Repeated ids that may be broadcast; beyond, all rows are told apart by the hash of their text.
BROADCAST_ROWS = 500_000


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, tx): each row whole, and two numbers that name its document even where ids repeat or are null.

    ``tx`` is 0 for ids that occur once, so that it takes no room in shuffles.
    """
    own = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id")
    named = docs.select(F.struct(*docs.columns).alias("row"), own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tx"))
    repeated = materialize(docs.select(own).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(1).alias("again")), "repeated")
    if repeated.count() > BROADCAST_ROWS:
        return named
    return named.join(F.broadcast(repeated), "id", "left").select("row", "id", F.when(F.col("again").isNull(), F.lit(0).cast("long")).otherwise(F.col("tx")).alias("tx"))


def later_occurrences(runs: DataFrame) -> DataFrame:
    """(id, tx, pos) of every occurrence but the first of each run.

    The first is found by an aggregation that combines before the shuffle, so a run that a third of the
    documents share is no hot group. First occurrences of repeated runs are written, so that the join
    back to the occurrences is a plain sort-merge join, which adaptive execution splits where one hash is frequent.
    """
    first = runs.groupBy("h1", "h2").agg(F.min(F.struct("id", "tx", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("h1", "h2", "first"), "first")
    return runs.join(first, ["h1", "h2"]).where(F.struct("id", "tx", "pos") != F.col("first")).select("id", "tx", "pos")


def covered_places(later: DataFrame) -> DataFrame:
    """The sorted places of later occurrences of each document."""
    return later.groupBy("id", "tx").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def merged(places: Column, length: int) -> Column:
    """Sorted starts of runs of ``length`` as disjoint intervals (first place, last place)."""
    first = F.filter(places, lambda p, i: F.coalesce(p > F.get(places, i - 1) + length, F.lit(True)))
    last = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) > p + length, F.lit(True)))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + length - 1).alias("last")))
