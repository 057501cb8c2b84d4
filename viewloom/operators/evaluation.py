"""Evaluation of class scores, and running statistics of a training log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan


def true_rank(scores: DataFrame) -> DataFrame:
    """(id, rank): the rank of the true class among the class scores (id, label, class, score), ties by class.

    The rank is one more than the number of better classes, so an aggregation does and no window sorts.
    """
    own = scores.where("class = label").select("id", F.col("score").alias("own"), F.col("label").alias("own_label"))
    better = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("class") < F.col("own_label")))
    return scores.join(own, "id").groupBy("id").agg((F.sum(F.when(better, 1).otherwise(0)) + 1).alias("rank"))


def top_k_accuracy(scores: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    r = true_rank(scores)
    return r.agg(*[F.avg((F.col("rank") <= k).cast("double") * 100).alias(f"top{k}_acc") for k in ks], *[F.avg((F.col("rank") > k).cast("double") * 100).alias(f"top{k}_err") for k in ks])


def ensemble(clips: DataFrame, views: int, how: str = "sum") -> DataFrame:
    """(point, class, score) over the clips (clip, view_order, class, score) of a point.

    Of repeated clips the first counts. ``max`` starts from 0, so negative scores become 0.
    """
    first = clips.groupBy("clip", "class").agg(F.min_by("score", "view_order").alias("score"))
    point = F.floor(F.col("clip") / views).alias("point")
    got = F.sum("score") if how == "sum" else F.greatest(F.lit(0.0), F.max("score"))
    return first.groupBy(point, "class").agg(got.alias("score"))


def rolling(log: DataFrame, window: int, size: int = scan.CHUNK) -> DataFrame:
    """Median and mean of the last ``window`` values and the mean of all, for each run's series (run, step, value); a
    series of any length is cut into chunks."""

    def median(value, last: W) -> Column:
        v = F.sort_array(F.collect_list(value("value")).over(last))
        n = F.size(v)
        return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2

    recent = scan.rolled(log, ["run"], ["step"], window, {"win_median": median, "win_avg": lambda value, last: F.avg(value("value")).over(last)}, size)
    summed = scan.running(recent, ["run"], ["step"], {"_sum": F.col("value"), "_n": F.col("value").isNotNull().cast("int")}, size)
    return summed.withColumn("global_avg", F.try_divide("_sum", "_n")).drop("_sum", "_n")


def weighted_epochs(log: DataFrame, value: str, weight: str) -> DataFrame:
    return log.groupBy("epoch").agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def eval_epoch(epoch: Column, period: int, last: int) -> Column:
    """Whether to evaluate after an epoch: every ``period``-th, and the last one."""
    return ((epoch + 1) % period == 0) | (epoch + 1 == last)


def precision_recall(chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of a set of ids."""
    joined = chosen.select("id").distinct().withColumn("c", F.lit(1)).join(truth.select("id").distinct().withColumn("t", F.lit(1)), "id", "full")
    n = joined.agg(F.sum(F.col("c") * F.col("t")).alias("both"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    p, r = F.coalesce(F.try_divide("both", "c"), F.lit(0.0)), F.coalesce(F.try_divide("both", "t"), F.lit(0.0))
    return n.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def json_line(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per row, floats to six places."""
    kinds = dict(df.dtypes)
    shown = [F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return df.select(F.to_json(F.struct(*shown)).alias("line"))


def spatial_view(index: Column, crops: int) -> tuple[Column, Column]:
    """Temporal and spatial place of a test view."""
    return F.floor(index / crops), index % crops


def view_start(delta: Column, index: Column, views: int) -> Column:
    """Start of a view when views are spread evenly over the spare length."""
    return F.greatest(delta, F.lit(0.0)) * index / F.lit(max(views - 1, 1))


def experiment_means(results: DataFrame, by: str, values: list[str]) -> DataFrame:
    """The mean of each value over repeated experiments."""
    return results.groupBy(by).agg(*[F.avg(v).alias(v) for v in values])


def positives_ratio(batches: DataFrame, truth: DataFrame) -> DataFrame:
    """(batch, ratio): which share of each batch's ids are true ones."""
    marked = batches.join(truth.select("id").distinct().withColumn("_true", F.lit(1)), "id", "left")
    return marked.groupBy("batch").agg(F.avg(F.coalesce("_true", F.lit(0))).alias("ratio"))


def compared_runs(runs: DataFrame) -> DataFrame:
    """(first, second, same, gain_difference) of all pairs of runs (run, pos, id, gain): the share of places with
    equal ids and the mean absolute difference of gains. Runs are few; places are joined."""
    a, b = (runs.select("pos", *[F.col(c).alias(f"{c}_{x}") for c in ("run", "id", "gain")]) for x in "ab")
    both = a.join(b, "pos").where("run_a < run_b")
    out = both.groupBy("run_a", "run_b").agg(F.avg((F.col("id_a") == F.col("id_b")).cast("int")).alias("same"), F.avg(F.abs(F.col("gain_a") - F.col("gain_b"))).alias("gain_difference"))
    return out.select(F.col("run_a").alias("first"), F.col("run_b").alias("second"), "same", "gain_difference")
