"""Contrastive projections of two views: loss, training and scores.

Two linear maps project both views; rows of one id should be close. The loss is the symmetric
cross-entropy of cosine similarities in a batch at a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering, rounds

TEMPERATURE = 0.1


@dataclass
class Projection:
    wa: np.ndarray  # d_a x m
    ba: np.ndarray
    wb: np.ndarray
    bb: np.ndarray

    @staticmethod
    def start(da: int, db: int, m: int, seed: int = 0) -> Projection:
        rng = np.random.default_rng(seed)
        return Projection(rng.normal(0, da**-0.5, (da, m)), np.zeros(m), rng.normal(0, db**-0.5, (db, m)), np.zeros(m))

    def parts(self) -> list[np.ndarray]:
        return [self.wa, self.ba, self.wb, self.bb]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / n, n


def loss_and_gradient(p: Projection, a: np.ndarray, b: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The batch's mean loss, and its gradient by the four parameters."""
    (ua, na), (ub, nb) = _unit(a @ p.wa + p.ba), _unit(b @ p.wb + p.bb)
    s = ua @ ub.T / TEMPERATURE
    n = len(a)

    def soft(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x - x.max(1, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        return float(-np.log(np.maximum(q[np.arange(n), np.arange(n)], 1e-300)).mean()), (q - np.eye(n)) / n

    l1, g1 = soft(s)
    l2, g2 = soft(s.T)
    g = (g1 + g2.T) / 2 / TEMPERATURE
    ga, gb = g @ ub, g.T @ ua
    ga, gb = ((x - u * (u * x).sum(1, keepdims=True)) / m for x, u, m in ((ga, ua, na), (gb, ub, nb)))
    return (l1 + l2) / 2, [a.T @ ga, ga.sum(0), b.T @ gb, gb.sum(0)]


@dataclass
class Adam:
    """Parameters with the running moments of their gradients, of which the largest second one is kept."""

    x: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    top: list[np.ndarray]

    @staticmethod
    def start(x: list[np.ndarray]) -> Adam:
        return Adam(x, *([np.zeros_like(v) for v in x] for _ in range(3)))

    def parts(self) -> list[np.ndarray]:
        return [*self.x, *self.first, *self.second, *self.top]

    @staticmethod
    def of(parts: list[np.ndarray], like: Adam) -> Adam:
        n = len(like.x)
        each = [p.reshape(v.shape) for p, v in zip(parts, like.parts(), strict=True)]
        return Adam(*(each[i : i + n] for i in range(0, 4 * n, n)))

    def step(self, gradient: list[np.ndarray], rate: float, t: int) -> Adam:
        """The ``t``-th step, counted from 1."""
        first = [0.9 * m + 0.1 * g for m, g in zip(self.first, gradient, strict=True)]
        second = [0.999 * v + 0.001 * g * g for v, g in zip(self.second, gradient, strict=True)]
        top = [np.maximum(a, v / (1 - 0.999**t)) for a, v in zip(self.top, second, strict=True)]
        moved = [x - rate * (m / (1 - 0.9**t)) / (np.sqrt(a) + 1e-8) for x, m, a in zip(self.x, first, top, strict=True)]
        return Adam(moved, first, second, top)


def train(rows: DataFrame, m: int = 16, epochs: int = 3, size: int = 128, rate: float = 2e-3, warm: int = 10, seed: int = 0, group_rows: int = rounds.GROUP_ROWS, parallel: int = rounds.PARALLEL) -> tuple[Projection, list[float]]:
    """The projection trained in batches of ``size`` rows (id, va, vb), and the mean loss of each round and epoch's batches.

    There are as many steps as the rows make batches: local steps in groups, whose parameters and moments are averaged;
    a table of at most ``group_rows`` rows is trained in one sequence. A batch of one row has no loss and makes no step.
    """
    head = rows.select("va", "vb").first()
    if head is None:
        raise ValueError("no rows to train on")
    state = Adam.start(Projection.start(len(head["va"]), len(head["vb"]), m, seed).parts())
    dealt = rounds.deal(rows, ["va", "vb"], "id", seed, group_rows, parallel)
    losses, t = [], 0
    for _ in range(epochs):
        for r in range(dealt.rounds):
            now, before = state, t

            def work(group: int, pdf: pd.DataFrame, now: Adam = now, before: int = before) -> list[np.ndarray]:
                s, lost, n = now, 0.0, 0
                for lo in range(0, len(pdf), size):
                    a, b = (np.stack(pdf[c].iloc[lo : lo + size].to_list()).astype(float) for c in ("va", "vb"))
                    if len(a) > 1:
                        loss, gradient = loss_and_gradient(Projection(*s.x), a, b)
                        n += 1
                        s, lost = s.step(gradient, rate * min(1, (before + n) / warm), before + n), lost + loss
                return [*s.parts(), np.array([lost, n], float)]

            found = list(dealt.round(r, work))
            steps = max((int(f[-1][1]) for f in found), default=0)
            if steps:
                state = Adam.of([sum(p) / len(found) for p in zip(*(f[:-1] for f in found), strict=True)], now)
                losses.append(float(sum(f[-1][0] for f in found) / sum(f[-1][1] for f in found)))
                t += steps
    dealt.drop()
    return Projection(*state.x), losses


def score(rows: DataFrame, p: Projection) -> DataFrame:
    """``rows`` with the cosine of both projections; the weights travel with the function, batch by batch as matrices."""

    @F.pandas_udf("double")
    def cosine(va: pd.Series, vb: pd.Series) -> pd.Series:
        if not len(va):
            return pd.Series([], dtype=float)
        a, b = _unit(np.stack(va.to_list()).astype(float) @ p.wa + p.ba)[0], _unit(np.stack(vb.to_list()).astype(float) @ p.wb + p.bb)[0]
        return pd.Series((a * b).sum(1))

    return rows.withColumn("score", cosine("va", "vb"))


def batched(rows: DataFrame, size: int, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """``rows`` with ``batch``: every ``size`` rows in md5(seed-id) order make one."""
    drawn = ordering.numbered(rows.withColumn("_draw", ordering.draw(seed)), ["_draw", "id"], "_pos", buckets)
    return drawn.withColumn("batch", ordering.chunks_of(F.col("_pos"), size)).drop("_draw", "_pos")


def batch_losses(rows: DataFrame) -> DataFrame:
    """(batch, n, loss): the symmetric loss of each batch of (id, va, vb) without a projection; a batch is one task's group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (_unit(np.stack(pdf[c].to_list()).astype(float))[0] for c in ("va", "vb"))
        s = a @ b.T / TEMPERATURE
        z = [np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) for x in (s, s.T)]
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "n": [len(pdf)], "loss": [(z[0].mean() + z[1].mean()) / 2 - np.diag(s).mean()]})

    return rows.select("batch", "va", "vb").groupBy("batch").applyInPandas(run, "batch long, n long, loss double")
