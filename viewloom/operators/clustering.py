"""Online k-means: training steps, assignment and models as small tables.

A model has k centres of d numbers, set by parameters and not by the data, so it travels as literals
of the plan's functions; LIMIT bounds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds

#: Numbers in a model.
LIMIT = 16_000_000
#: A centre with under (total / k) ** UNDER_USE rows has its distances divided by DISCOUNT.
UNDER_USE, DISCOUNT = 0.7, 5.0


@dataclass
class Model:
    centers: np.ndarray  # k x d
    counts: np.ndarray  # rows assigned to each so far

    def __post_init__(self):
        if self.centers.size > LIMIT:
            raise ValueError(f"a model of over {LIMIT} numbers")

    def distances(self, x: np.ndarray, discount: bool) -> np.ndarray:
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centers.T + (self.centers * self.centers).sum(1)[None], 0)
        if discount:
            few = self.counts < (self.counts.sum() / len(self.counts)) ** UNDER_USE
            d = d / np.where(few, DISCOUNT, 1.0)
        return d


def model_of(centers: DataFrame, counts: str | None = None) -> Model:
    """A model from (k, center[, count]) rows, of which there are k."""
    rows = centers.orderBy("k").collect()
    return Model(np.array([r["center"] for r in rows], float), np.array([r[counts] if counts else 1 for r in rows], float))


def assign(rows: DataFrame, models: dict[str, Model], vec: str = "vec", clustering: str = "clustering", discount: bool = False) -> DataFrame:
    """``rows`` with ``centroid`` and ``distance`` of the nearest centre in the row's clustering; no shuffle."""

    @F.pandas_udf("centroid int, distance double")
    def nearest(name: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"centroid": np.full(len(name), -1, np.int32), "distance": np.full(len(name), np.nan)})
        for n in name.unique():
            at = np.flatnonzero((name == n).to_numpy())
            d = models[n].distances(np.stack(v.iloc[at].to_list()).astype(float), discount)
            out.iloc[at, 0] = d.argmin(1).astype(np.int32)
            out.iloc[at, 1] = d.min(1)
        return out

    keep = [c for c in rows.columns if c != vec]
    return rows.select(*keep, nearest(clustering, vec).alias("_n")).select(*keep, "_n.centroid", "_n.distance")


def step(model: Model, sums: np.ndarray, counts: np.ndarray, rate: float) -> Model:
    """One update from the sums and numbers of a batch's rows per centre: a centre keeps 1 - n * rate of itself and
    takes ``rate`` of each of its n rows. Where the largest n would leave nothing of a centre the rate is half its inverse."""
    most = counts.max(initial=0)
    if most * rate >= 1:
        rate = 0.5 / most
    return Model(model.centers * (1 - counts * rate)[:, None] + rate * sums, model.counts + counts)


def gather(rows: DataFrame, model: Model, vec: str = "vec", discount: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums, counts and mean distance of a batch: k rows come back, combined per task first."""
    k, d = model.centers.shape

    def part(batches):
        s, n, far, rows_ = np.zeros((k, d)), np.zeros(k), 0.0, 0
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[vec].to_list()).astype(float)
            dist = model.distances(x, discount)
            at = dist.argmin(1)
            np.add.at(s, at, x)
            n += np.bincount(at, minlength=k)
            far, rows_ = far + float(dist.min(1).sum()), rows_ + len(x)
        yield pd.DataFrame({"k": np.arange(k), "s": list(s), "n": n, "far": far / k, "rows": rows_ / k})

    got = rows.select(vec).mapInPandas(part, "k int, s array<double>, n double, far double, rows double")
    got = got.select("k", "n", "far", "rows", F.posexplode("s").alias("pos", "x")).groupBy("k", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum("rows").alias("rows"))
    out = got.toPandas().sort_values(["k", "pos"])
    if not len(out):
        return np.zeros((k, d)), np.zeros(k), 0.0
    sums = out["x"].to_numpy().reshape(k, d)
    first = out.drop_duplicates("k")
    return sums, first["n"].to_numpy(), float(first["far"].sum() / max(first["rows"].sum(), 1))


def local_steps(model: Model, x: np.ndarray, batch: int, rate: float, initial_rounds: int, rng: np.random.Generator) -> Model:
    """Steps over batches of rows in order. Until ``initial_rounds`` rows per centre have been seen, rows go to random centres."""
    k = len(model.centers)
    for lo in range(0, len(x), batch):
        part = x[lo : lo + batch]
        random = model.counts.sum() < initial_rounds * k
        at = (rng.random((len(part), k)) if random else model.distances(part, True)).argmin(1)
        sums = np.zeros_like(model.centers)
        np.add.at(sums, at, part)
        model = step(model, sums, np.bincount(at, minlength=k).astype(float), rate)
    return model


def averaged(model: Model, found: list[Model]) -> Model:
    """Models that went on from ``model`` side by side as one: centres weighted by the rows each has given them, counts added up."""
    if len(found) == 1:
        return found[0]
    new = [m.counts - model.counts for m in found]
    total = sum(new)
    moved = sum(n[:, None] * m.centers for n, m in zip(new, found, strict=True))
    centers = np.where(total[:, None] > 0, moved / np.maximum(total, 1)[:, None], model.centers)
    return Model(centers, model.counts + total)


def train(rows: DataFrame, k: int, epochs: int = 2, batch: int = 32, seed: int = 0, vec: str = "vec", key: str = "id", rate=lambda e: 0.1 ** (2 + e // 5), initial_rounds: int = 10, group_rows: int = rounds.GROUP_ROWS, parallel: int = rounds.PARALLEL) -> Model:
    """Training in batches of ``batch`` rows, as many steps as the rows make: local steps in groups whose models are averaged.

    Centres start near zero. A table of at most ``group_rows`` rows is trained in one sequence.
    """
    width = rows.select(F.size(vec).alias("d")).first()
    model = Model(np.random.default_rng(seed).random((k, width["d"] if width else 0)) * 1e-5, np.zeros(k))
    dealt = rounds.deal(rows, [vec], key, seed, group_rows, parallel)
    for e in range(epochs):
        for r in range(dealt.rounds):
            now = model

            def work(group: int, pdf: pd.DataFrame, now: Model = now, e: int = e) -> list[np.ndarray]:
                m = local_steps(now, np.stack(pdf[vec].to_list()).astype(float), batch, rate(e), initial_rounds, np.random.default_rng([seed, e, group]))
                return [m.centers, m.counts]

            model = averaged(now, [Model(c.reshape(now.centers.shape), n) for c, n in dealt.round(r, work)])
    dealt.drop()
    return model


def whiten(rows: DataFrame, by: str = "clustering", vec: str = "vec") -> DataFrame:
    """Each dimension divided by its population deviation in its clustering, without centring; clusterings x d
    numbers are joined back."""
    dev = rows.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.stddev_pop(F.col("x").cast("double")).alias("s"))
    all_dev = dev.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p.s).alias("_s"))
    return rows.join(F.broadcast(all_dev), by).withColumn(vec, F.zip_with(vec, "_s", lambda x, s: F.try_divide(x.cast("double"), s))).drop("_s")


def principal(rows: DataFrame, n: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(mean, n principal axes) from sums of products that each task forms.

    A task returns them as d + 1 rows of arrays, which are added up row by row before the driver gets one matrix of
    (d + 1)² numbers, LIMIT at most.
    """
    width = rows.select(F.size(vec).alias("d")).first()["d"]
    if (width + 1) ** 2 > LIMIT:
        raise ValueError(f"a matrix of over {LIMIT} numbers")

    def part(batches):
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_list()).astype(float)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    kind = "i int, v array<double>"
    got = rows.select(vec).mapInPandas(part, kind).groupBy("i").applyInPandas(added, kind).collect()
    m = np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])
    count, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / count - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    return mean, axes[:, ::-1][:, :n].T


def library(rows: DataFrame, k: int, vec: str = "vec", epochs: int = 20, seed: int = 0) -> Model:
    """Spark's own k-means over whole rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    found = KMeans(k=k, maxIter=epochs, seed=seed, featuresCol="_x").fit(rows.select(array_to_vector(vec).alias("_x")))
    return Model(np.array(found.clusterCenters()), np.array(found.summary.clusterSizes, float))


#: Ways to cluster, each from rows and k to a model.
CLUSTERINGS = {"online": train, "library": library}


def cluster_all(rows: DataFrame, ks: list[int], kind: str = "online", **options) -> dict[str, Model]:
    """A model for each clustering name in ``rows`` (clustering, vec, id) and each k, named name_k if there are several."""
    names = sorted(r[0] for r in rows.select("clustering").distinct().collect())  # a handful, set by the extractors
    return {f"{n}_{k}" if len(ks) > 1 else n: CLUSTERINGS[kind](rows.where(F.col("clustering") == n), k, **options) for n in names for k in ks}
