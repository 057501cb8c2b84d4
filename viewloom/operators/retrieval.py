"""Retrieval experiments: planted truth, similarity selection and prefix metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SIMILARITIES
from ..sources.scratch import materialize
from . import scan
from .ordering import draw, numbered, numbered_by


def clip_classes(views: DataFrame, cap: int | None = None, buckets: int | None = None) -> DataFrame:
    """Rows (view, id, label) cut so that all views have the classes and class sizes that they share.

    Classes are those of every view in label order up to the least class count; sizes are the least over
    views, at most ``cap``.
    """
    placed = numbered_by(views.select("view", "id", "label"), ["view", "label"], ["id"], "pos", "n", buckets)
    counts = views.groupBy("view", "label").agg(F.count("*").alias("n"))
    ranked = numbered_by(counts, ["view"], ["label"], "c", "classes").withColumn("c", F.col("c") + 1)
    n_views = counts.select("view").distinct().count()  # a handful, set by the experiment
    size = ranked.groupBy("c").agg(F.min("n").alias("m"), F.count("*").alias("k")).where(F.col("k") == n_views)
    if cap is not None:
        size = size.withColumn("m", F.least("m", F.lit(cap)))
    keep = ranked.join(size, "c").select("view", "label", "c", "m")
    out = placed.withColumn("pos", F.col("pos") + 1).join(keep, ["view", "label"])
    return out.where(F.col("pos") <= F.col("m")).select("view", "id", "label", F.col("c").alias("class"), "pos")


def aligned(views: DataFrame, n_views: int) -> DataFrame:
    """Ids that occur in every view."""
    return views.groupBy("id").agg(F.count_distinct("view").alias("n")).where(F.col("n") == n_views).select("id")


def derange_within(rows: DataFrame, ratio: float, seed: int, by: list[str], key: str = "id", buckets: int | None = None) -> DataFrame:
    """``rows`` with ``partner`` and ``is_true``: in each group the first rows in md5 order keep their partner, the
    next get each other's, one on, so none of these keeps its own (unless alone).

    Partners meet by their place in the group, which is a key of its own; no group is held by one task.
    """
    n = numbered_by(rows.withColumn("_draw", draw(seed, key)), by, ["_draw", key], "_pos", "_size", buckets).drop("_draw")
    same = F.floor(F.col("_size") * F.lit(ratio))
    after = F.when(F.col("_pos") < same, F.col("_pos")).when(F.col("_pos") + 1 < F.col("_size"), F.col("_pos") + 1).otherwise(same)
    n = materialize(n.withColumn("_next", after), "placed")
    partner = n.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_pos").alias("_next"), F.col(key).alias("partner"))
    on = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    out = n.alias("n").join(partner.alias("p"), [*on, F.col("n._next") == F.col("p._next")])
    return out.select(*[F.col(f"n.{c}").alias(c) for c in rows.columns], "partner").withColumn("is_true", F.col("partner") == F.col(key))


def by_similarity(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """The n rows (id, va, vb) whose views are most alike."""
    return rows.select("id", SIMILARITIES[kind](F.col("va"), F.col("vb")).alias("score")).orderBy(F.desc(F.round("score", 6)), "id").limit(n)


def gain(scores: DataFrame, size: int = scan.CHUNK) -> DataFrame:
    """The score plus that of the row before in its run (run, pos, score); a run of any length is cut into chunks."""
    before = lambda value, last: value("score") + F.coalesce(F.first(value("score")).over(last.rowsBetween(-1, -1)), F.lit(0.0))
    return scan.rolled(scores, ["run"], ["pos"], 2, {"gain": before}, size)


def prefix_metrics(chosen: DataFrame, truth: DataFrame, size: int = scan.CHUNK) -> DataFrame:
    """Precision, recall and F1 of each prefix of runs (run, pos, id) against true ids; F1 is 0 where both are 0.

    Hits and rows are running sums, so a run of any length is cut into chunks.
    """
    total = truth.agg(F.count("*").alias("_total"))
    marked = chosen.select("run", "pos", "id").join(truth.select("id", F.lit(1).alias("_true")), "id", "left")
    summed = scan.running(marked, ["run"], ["pos"], {"_hits": F.coalesce("_true", F.lit(0)), "_n": F.lit(1)}, size).crossJoin(F.broadcast(total))
    out = summed.select("run", "pos", "id", (F.col("_hits") / F.col("_n")).alias("precision"), (F.col("_hits") / F.col("_total")).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def start_per_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.min("id").alias("id"))


def sharded(rows: DataFrame, shards: int, size: int | None = None, buckets: int | None = None) -> DataFrame:
    """``rows`` (id, ...) with ``shard`` and ``local``: every ``size`` rows in id order make a shard; what lies beyond
    the last one stays in it. Without a size the rows are counted and dealt evenly. A row's global place is shard * size + local."""
    size = size or max(1, -(-rows.count() // shards))
    n = numbered(rows, ["id"], "_pos", buckets)
    shard = F.least(F.floor(F.col("_pos") / size), F.lit(shards - 1))
    return n.withColumns({"shard": shard, "local": F.col("_pos") - shard * size}).drop("_pos")


def shards_for(rows: int, most: int) -> int:
    """So many shards that none has more than ``most`` of ``rows`` rows."""
    return max(1, -(-rows // most))


def sharded_selection(rows: DataFrame, pairs: list, ratio: float, shards: int, size: int | None = None, buckets: int | None = None, **options) -> DataFrame:
    """(shard, place, rank, score): a selection of each shard (id, a) by itself, with places in the whole set."""
    from .selection import select

    size = size or max(1, -(-rows.count() // shards))
    dealt = sharded(rows, shards, size, buckets)
    got = select(dealt.select("shard", F.col("local").alias("id"), "a"), pairs, ratio, chunk="shard", **options)
    return got.select("shard", (F.col("shard") * size + F.col("id")).alias("place"), "rank", "score")
