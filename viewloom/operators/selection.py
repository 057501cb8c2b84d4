"""Greedy selection of rows whose clusterings agree most.

A step depends on the one before, so a chunk of rows is one grouped task with numpy, and chunks run side
by side; a chunk's size is a parameter and bounds a task's memory. Within a chunk a row is its
centroids; scores of all candidates come from the counts by the incremental forms.

Strategies: ``greedy`` adds the best row at each step, ``batch`` scores ``batch`` random candidates alone
against the state and adds the best ``take`` together, ``lazy`` keeps stale gains in a heap and refreshes the top.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import agreement, ordering
from .pairing import Pair


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


class Counts:
    """Contingency counts of the selected rows for all pairs, with both marginals."""

    def __init__(self, rows: np.ndarray, pairs: list[Pair]):
        self.first, self.second = (rows[:, [p[k] for p in pairs]] for k in (0, 1))
        c, p = int(rows.max(initial=0)) + 1, len(pairs)
        self.cells, self.of_first, self.of_second, self.n = np.zeros((p, c, c)), np.zeros((p, c)), np.zeros((p, c)), 0
        self.at = np.arange(p)

    def add(self, ids: np.ndarray) -> None:
        for r in ids:
            i, j = self.first[r], self.second[r]
            self.cells[self.at, i, j] += 1
            self.of_first[self.at, i] += 1
            self.of_second[self.at, j] += 1
            self.n += 1

    def around(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each candidate's cell and marginal counts, per pair."""
        i, j = self.first[ids], self.second[ids]
        return self.cells[self.at, i, j], self.of_first[self.at, i], self.of_second[self.at, j]


def over_pairs(each):
    """A score per candidate, the mean of ``each``'s values per candidate and pair, which stay at hand as ``each``."""

    @wraps(each)
    def score(state: Counts, ids: np.ndarray) -> np.ndarray:
        return each(state, ids).mean(axis=1)

    score.each = each
    return score


@over_pairs
def information(state: Counts, ids: np.ndarray) -> np.ndarray:
    """Mean MI over pairs after adding each candidate alone."""
    c, a, b = state.around(ids)
    total = [_xlogx(x).sum(axis=tuple(range(1, x.ndim))) for x in (state.cells, state.of_first, state.of_second)]
    grown = [t + _xlogx(x + 1) - _xlogx(x) for t, x in zip(total, (c, a, b), strict=True)]
    n = state.n + 1
    return (grown[0] - grown[1] - grown[2]) / n + math.log(n)


def _information_order(state: Counts) -> np.ndarray:
    """(pairs, c, c): what orders candidates by MI. Only the cells, rows and columns of an added row change in it."""
    grown = lambda x: _xlogx(x + 1) - _xlogx(x)
    return grown(state.cells) - grown(state.of_first)[:, :, None] - grown(state.of_second)[:, None, :]


information.order = _information_order


def _entropy(t: np.ndarray, n: int) -> np.ndarray:
    return math.log(n) - t / n


@over_pairs
def normalized_information(state: Counts, ids: np.ndarray) -> np.ndarray:
    c, a, b = state.around(ids)
    total = [_xlogx(x).sum(axis=tuple(range(1, x.ndim))) for x in (state.cells, state.of_first, state.of_second)]
    g = [t + _xlogx(x + 1) - _xlogx(x) for t, x in zip(total, (c, a, b), strict=True)]
    n = state.n + 1
    mi = (g[0] - g[1] - g[2]) / n + math.log(n)
    mean = (_entropy(g[1], n) + _entropy(g[2], n)) / 2
    return mi / np.maximum(mean, np.finfo(float).eps)


def _pair_counts(state: Counts, ids: np.ndarray):
    """tp, fp, fn, tn per candidate and pair; adding a row to a group of x makes x new pairs."""
    c, a, b = state.around(ids)
    two = [(x * (x - 1) / 2).sum(axis=tuple(range(1, x.ndim))) for x in (state.cells, state.of_first, state.of_second)]
    both, first, second = (t + x for t, x in zip(two, (c, a, b), strict=True))
    n = state.n + 1
    return both, second - both, first - both, n * (n - 1) / 2 - first - second + both


def _safe(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros_like(x, dtype=float), where=y != 0)


@over_pairs
def fowlkes_mallows(state: Counts, ids: np.ndarray) -> np.ndarray:
    tp, fp, fn, _ = _pair_counts(state, ids)
    return np.sqrt(_safe(tp, tp + fp) * _safe(tp, tp + fn))


@over_pairs
def rand(state: Counts, ids: np.ndarray) -> np.ndarray:
    tp, fp, fn, tn = _pair_counts(state, ids)
    return _safe(tp + tn, tp + fp + fn + tn)


@over_pairs
def adjusted_rand(state: Counts, ids: np.ndarray) -> np.ndarray:
    tp, fp, fn, tn = _pair_counts(state, ids)
    return _safe(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))


def _expected_information(a: np.ndarray, b: np.ndarray) -> float:
    """The mean MI of random tables with marginals ``a`` and ``b``."""
    a, b = a[a > 0], b[b > 0]
    n = int(a.sum())
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])  # of factorials
    x, y = (v.astype(int) for v in np.meshgrid(a, b, indexing="ij"))
    low, high = np.maximum(1, x + y - n).ravel(), np.minimum(x, y).ravel()
    count = high - low + 1
    x, y = np.repeat(x.ravel(), count), np.repeat(y.ravel(), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    log_p = logs[x] + logs[y] + logs[n - x] + logs[n - y] - logs[n] - logs[k] - logs[x - k] - logs[y - k] - logs[n - x - y + k]
    return float((k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum())


@over_pairs
def adjusted_information(state: Counts, ids: np.ndarray) -> np.ndarray:
    """Mean usual AMI; the expectation depends on the marginals alone, so it is found once for each pair of centroids."""
    c, a, b = state.around(ids)
    total = [_xlogx(x).sum(axis=tuple(range(1, x.ndim))) for x in (state.cells, state.of_first, state.of_second)]
    g = [t + _xlogx(x + 1) - _xlogx(x) for t, x in zip(total, (c, a, b), strict=True)]
    n = state.n + 1
    mi = (g[0] - g[1] - g[2]) / n + math.log(n)
    known: dict[tuple[int, int, int], float] = {}
    emi = np.empty_like(mi)
    for r, (i, j) in enumerate(zip(state.first[ids], state.second[ids], strict=True)):
        for p in state.at:
            at = (int(p), int(i[p]), int(j[p]))
            if at not in known:
                u, v = state.of_first[p].copy(), state.of_second[p].copy()
                u[at[1]] += 1
                v[at[2]] += 1
                known[at] = _expected_information(u, v)
            emi[r, p] = known[at]
    below = (_entropy(g[1], n) + _entropy(g[2], n)) / 2 - emi
    eps = np.finfo(float).eps
    return ((mi - emi) / np.where(below < 0, np.minimum(below, -eps), np.maximum(below, eps)))


@over_pairs
def covered(state: Counts, ids: np.ndarray) -> np.ndarray:
    """Cells with a row in them; what a row adds only shrinks as others are added."""
    c, _, _ = state.around(ids)
    return (state.cells > 0).sum(axis=(1, 2)) + (c == 0)


def constant(state: Counts, ids: np.ndarray) -> np.ndarray:
    return np.ones(len(ids))


Score = Callable[[Counts, np.ndarray], np.ndarray]
MEASURES: dict[str, Score] = {"mi": information, "ami": adjusted_information, "nmi": normalized_information, "fm": fowlkes_mallows, "rand": rand, "arand": adjusted_rand, "covered": covered, "constant": constant}


def greedy(rows: np.ndarray, pairs: list[Pair], size: int, score: Score, start: list[int]) -> list[tuple[int, float]]:
    """(row, score) in the order chosen; ties go to the smaller row."""
    state, out = Counts(rows, pairs), [(s, 0.0) for s in start]
    state.add(np.array(start, int))
    left = np.setdiff1d(np.arange(len(rows)), start)
    while len(out) < size and len(left):
        s = score(state, left)
        at = int(s.argmax())
        out.append((int(left[at]), float(s[at])))
        state.add(left[at : at + 1])
        left = np.delete(left, at)
    return out[:size]


def batch(rows: np.ndarray, pairs: list[Pair], size: int, score: Score, start: list[int], width: int = 20, take: int = 4, keep: bool = True) -> list[tuple[int, float]]:
    """Takes ``width`` candidates in row order (shuffle before), adds their best ``take``, returns the rest to the end."""
    state, out = Counts(rows, pairs), [(s, 0.0) for s in start]
    state.add(np.array(start, int))
    queue = [r for r in range(len(rows)) if r not in set(start)]
    while len(out) < size and queue:
        now, queue = np.array(queue[:width]), queue[width:]
        s = score(state, now)
        n = min(take, max(1, math.ceil(take * len(now) / width)), size - len(out))
        order = np.lexsort((now, -s))
        best = now[order[:n]]
        out += [(int(r), float(v)) for r, v in zip(best, s[order[:n]], strict=True)]
        state.add(best)
        if keep:
            queue += [int(r) for r in now[np.sort(order[n:])]]
    return out[:size]


def lazy(rows: np.ndarray, pairs: list[Pair], size: int, score: Score, start: list[int], plain: float = 0.0) -> list[tuple[int, float]]:
    """Lazy greedy: exact if gains only shrink, which these measures do not promise.

    The first ``plain`` share of the steps is plain greedy.
    """
    first = len(start) + round((size - len(start)) * plain) if size > len(start) else size
    out = greedy(rows, pairs, first, score, start) if plain else [(s, 0.0) for s in start]
    state = Counts(rows, pairs)
    state.add(np.array([r for r, _ in out], int))
    left = np.setdiff1d(np.arange(len(rows)), [r for r, _ in out])
    heap = [(-float(v), int(r), 0) for r, v in zip(left, score(state, left), strict=True)] if len(left) else []
    heapq.heapify(heap)
    step = 0
    while len(out) < size and heap:
        v, r, seen = heapq.heappop(heap)
        if seen < step:
            heapq.heappush(heap, (-float(score(state, np.array([r]))[0]), r, step))
            continue
        out.append((r, -v))
        state.add(np.array([r]))
        step += 1
    return out[:size]


def hybrid(rows: np.ndarray, pairs: list[Pair], size: int, score: Score, start: list[int], ratio: float = 0.5) -> list[tuple[int, float]]:
    """Plain greedy for the first 1 - ``ratio`` of the steps, lazy greedy for the rest."""
    return lazy(rows, pairs, size, score, start, plain=1 - ratio)


STRATEGIES = {"greedy": greedy, "batch": batch, "lazy": lazy, "hybrid": hybrid}


def start_rows(kind: str, rows: np.ndarray, labels: np.ndarray | None = None) -> list[int]:
    """``zero``: the first row; ``class``: the first of each class; ``cluster``: rows until every centroid of each clustering is covered."""
    if kind == "zero":
        return [0] if len(rows) else []
    if kind == "class":
        return sorted(int(np.flatnonzero(labels == v)[0]) for v in np.unique(labels))
    seen: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        new = {(c, int(v)) for c, v in enumerate(row)} - seen
        if new:
            out.append(r)
            seen |= new
    return out


def chunked(rows: DataFrame, size: int, seed: int = 98052, buckets: int | None = None) -> DataFrame:
    """``rows`` with ``chunk``: every ``size`` rows in md5(seed-id) order make one, however many there are."""
    drawn = ordering.numbered(rows.withColumn("_draw", ordering.draw(seed)), ["_draw", "id"], "_pos", buckets)
    return drawn.withColumn("chunk", ordering.chunks_of(F.col("_pos"), size)).drop("_draw", "_pos")


def step_scores(selected: DataFrame, candidates: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(id, score): the mean MI over pairs after adding each candidate alone, scored as one aggregation over the
    counts of the selected rows."""
    have = agreement.contingency(selected, pairs)
    return agreement.mi_after_adding(agreement.sums(have), have, candidates, pairs).groupBy("id").agg(F.avg("mi").alias("score"))


def select(rows: DataFrame, pairs: list[Pair], ratio: float, chunk: str = "chunk", measure: str | Score = "mi", strategy: str = "batch", start: str = "zero", seed: int = 98052, **options) -> DataFrame:
    """(chunk, id, rank, score): ``ratio`` of each chunk's rows (id, a), chosen independently of other chunks.

    ``measure`` is a name of MEASURES or a function of the counts and candidate rows. Rows enter in md5(seed-id) order. Memory of a task: rows of a chunk x clusterings, plus pairs x centroids squared.
    """

    score = MEASURES[measure] if isinstance(measure, str) else measure

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_draw", "id"], ignore_index=True)
        a = np.array(pdf["a"].tolist(), int)
        size = max(1, round(len(pdf) * ratio))
        got = STRATEGIES[strategy](a, pairs, size, score, start_rows(start, a), **options)
        return pd.DataFrame({chunk: pdf[chunk].iloc[0], "id": pdf["id"].to_numpy()[[r for r, _ in got]], "rank": np.arange(len(got)), "score": [s for _, s in got]})

    types = dict(rows.dtypes)
    drawn = rows.select(chunk, "id", "a", F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))).alias("_draw"))
    return drawn.groupBy(chunk).applyInPandas(run, f"{chunk} {types[chunk]}, id {types['id']}, rank long, score double")
