"""Greedy selection over a whole table, without a task that holds all rows.

A row's score depends on its centroids alone: after each step the driver makes, from pairs x centroids squared
counts, a table whose entries add up to the value of any row. Rows lie in parts, written once. A job scores the
rows of some parts; each of its tasks returns, for each part, its ``keep`` best rows and the value of the best one that it
leaves out. The driver then goes on by itself: it scores the rows it has been given with each step's table
and takes the best as long as no row left behind can be better, by what is known of the parts:

* ``exact``: since it was scored, a value has grown by no more than the table has at the cells that have grown most, where a
  clustering has one centroid in all its pairs (``Growth``), so that is added to the parts' bounds. Holds for any measure. Where a
  bound reaches the best value, all parts that have rows left out are scored again: rows are dealt to parts by their ids, so parts are alike.
* ``lazy``: bounds stay as they are, which is right where gains only shrink. Bounds of other measures are
  then mere guesses, as in any lazy greedy. Where a bound reaches the best value, the parts concerned, and no
  others, are scored again. Parts are cut by the gain at the start, so rows of large bounds are in few of them.

The driver scores its own candidates in the same way: a short list of the best at each step, the others when their bound reaches it.

Ties go to the smallest id; values are compared to nine places. Rows with a null id or centroid are no candidates;
ids are distinct; extra columns are ignored; a start outside the table counts for nothing; with fewer candidates than steps
all are chosen. The driver holds one row per step, and tasks x parts x ``keep`` candidates of a job, of which parts x ``keep`` are
CANDIDATES unless ``keep`` is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import agreement
from .pairing import Pair
from .selection import MEASURES, Counts, Score

#: Rows of a part; parts at most; numbers of a table at most; ids that are broadcast at most.
PART_ROWS, PARTS, LARGEST_TABLE, BROADCAST_ROWS = 100_000, 1024, 1 << 24, 500_000
#: Rows that the driver asks for in a job; the best of them, which it scores at each step.
CANDIDATES, LISTED = 1 << 15, 1024
#: Values closer than this are told apart by id.
PLACES, SLACK = 9, 2e-9


class Grid(Counts):
    """Counts whose candidates are the cells: candidate i * c + j has centroids i and j in every pair."""

    def __init__(self, pairs: list[Pair], centroids: int):
        width = max((max(p) for p in pairs), default=0) + 1
        super().__init__(np.full((1, width), centroids - 1), pairs)
        self.size, self.pairs = centroids, pairs
        i, j = np.divmod(np.arange(centroids * centroids), centroids)
        self.first, self.second = (np.repeat(x[:, None], len(pairs), 1) for x in (i, j))

    def load(self, cells: np.ndarray) -> None:
        self.cells = cells.astype(float)
        self.of_first, self.of_second = self.cells.sum(axis=2), self.cells.sum(axis=1)
        self.n = int(self.cells[0].sum()) if len(cells) else 0

    def put(self, row: np.ndarray, times: int = 1) -> None:
        i, j = row[[p[0] for p in self.pairs]], row[[p[1] for p in self.pairs]]
        self.cells[self.at, i, j] += times
        self.of_first[self.at, i] += times
        self.of_second[self.at, j] += times
        self.n += times

    def score_with(self, score: Score, row: np.ndarray) -> float:
        """The score after adding a row."""
        one = copy(self)
        one.first, one.second = (row[None, [p[k] for p in self.pairs]] for k in (0, 1))
        return float(score(one, np.array([0]))[0])

    def only(self, p: int) -> Counts:
        """The counts of one pair."""
        out = object.__new__(Counts)
        out.first, out.second = self.first[:, p : p + 1], self.second[:, p : p + 1]
        out.cells, out.of_first, out.of_second = (x[p : p + 1] for x in (self.cells, self.of_first, self.of_second))
        out.n, out.at = self.n, np.arange(1)
        return out

    def table(self, score: Score) -> np.ndarray:
        """(pairs, c, c): each pair's part of the score after adding a row of these two centroids."""
        each, all_ = getattr(score, "each", None), np.arange(self.size * self.size)
        values = each(self, all_).T if each else np.stack([score(self.only(p), all_) for p in range(len(self.pairs))])
        return values.reshape(len(self.pairs), self.size, self.size) / len(self.pairs)


def cells_of(rows: np.ndarray, pairs: list[Pair], size: int) -> np.ndarray:
    """(pairs, rows): where each row's entries lie in a flat table of ``size`` centroids."""
    return np.stack([(p * size + rows[:, x]) * size + rows[:, y] for p, (x, y) in enumerate(pairs)]) if pairs else np.zeros((0, len(rows)), np.int64)


def value_at(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The sum over pairs of the table's entries at each row's cells."""
    flat, out = table.ravel(), np.zeros(cells.shape[1])
    for c in cells:
        out += flat[c]
    return np.round(out, PLACES)


def value_of(table: np.ndarray, rows: np.ndarray, pairs: list[Pair]) -> np.ndarray:
    return value_at(table, cells_of(rows, pairs, table.shape[-1]))


class Growth:
    """How much the value of any row can have grown between two tables.

    A row has one centroid in each clustering. So of half the sum, over clusterings, of what its pairs have grown by, each
    clustering's share is at most that of its best centroid, with the best one on the other side of each pair.
    """

    def __init__(self, pairs: list[Pair]):
        self.sides = np.zeros((2, max((max(p) for p in pairs), default=0) + 1, len(pairs)))
        for p, pair in enumerate(pairs):
            for side, clustering in zip(self.sides, pair, strict=True):
                side[clustering, p] += 0.5

    def __call__(self, now: np.ndarray, then: np.ndarray) -> float:
        grown = now - then
        return float((self.sides[0] @ grown.max(axis=2) + self.sides[1] @ grown.max(axis=1)).max(axis=1).sum())


def _best(values: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -values))[:n]


FOUND = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("a", pa.list_(pa.int32())), ("value", pa.float64()), ("rest", pa.bool_()), ("n", pa.int64())])


def _among(ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which ids are in the sorted ``gone``."""
    return gone[np.minimum(np.searchsorted(gone, ids), len(gone) - 1)] == ids if len(gone) else np.zeros(len(ids), bool)


def best_of_parts(rows: DataFrame, table: np.ndarray, pairs: list[Pair], keep: int, gone: list[int]) -> pa.Table:
    """Of each task and part of ``rows`` (part, id, a) without the ids ``gone`` the ``keep`` best rows, and one marked ``rest``: value and id of the best of the others, and how many were scored."""
    few = len(gone) <= BROADCAST_ROWS
    sent = rows.sparkSession.sparkContext.broadcast((table, np.sort(np.array(gone if few else [], np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gone = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # values, ids and rows
        rest: dict[int, list] = {}  # value and id of the best row left out, rows seen
        for b in batches:
            a = np.asarray(b.column("a").flatten()).reshape(b.num_rows, -1)
            ids, part = np.asarray(b.column("id")), np.asarray(b.column("part"))
            values, left = value_of(table, a, pairs), ~_among(ids, gone)
            for p in np.unique(part).tolist():
                mine = left & (part == p)
                v, i, r = values[mine], ids[mine], a[mine]
                seen = rest.setdefault(p, [-np.inf, 0, 0])
                seen[2] += len(v)
                if p in held:
                    v, i, r = (np.concatenate([x, y]) for x, y in zip(held[p], (v, i, r), strict=True))
                order = _best(v, i, keep + 1)
                if len(order) > keep:
                    seen[:2] = max(seen[:2], [float(v[order[keep]]), int(i[order[keep]])], key=lambda x: (x[0], -x[1]))
                held[p] = v[order[:keep]], i[order[:keep]], r[order[:keep]]
        for p, (v, i, r) in held.items():
            n = len(v)
            a = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * r.shape[1], pa.array(r.ravel(), pa.int32()))
            yield pa.RecordBatch.from_pydict({"part": [p] * n, "id": i, "a": a, "value": v, "rest": [False] * n, "n": [0] * n}, schema=FOUND)
            yield pa.RecordBatch.from_pydict({"part": [p], "id": [rest[p][1]], "a": [None], "value": [rest[p][0]], "rest": [True], "n": [rest[p][2]]}, schema=FOUND)

    left = (rows if few else _without(rows, gone)).select("part", "id", "a")
    found = left.mapInArrow(run, "part int, id long, a array<int>, value double, rest boolean, n long").toArrow()
    sent.destroy()
    return found


@dataclass
class Pool:
    """What the driver knows: candidates of the parts, and for each part the bound of its other rows."""

    pairs: list[Pair]
    size: int
    width: int
    bounds: np.ndarray
    ids: np.ndarray = field(init=False)
    fresh: np.ndarray = field(init=False)
    bound_ids: np.ndarray = field(init=False)  # the least id of a row that had its part's bound

    def __post_init__(self) -> None:
        self.fresh, self.bound_ids = np.zeros(len(self.bounds), bool), np.zeros(len(self.bounds), np.int64)
        self.ids, self.rows, self.parts = np.zeros(0, np.int64), np.zeros((0, self.width), np.int32), np.zeros(0, np.int64)
        self.growth = Growth(self.pairs)
        self._begin()

    def _begin(self) -> None:
        self.cells, self.left = cells_of(self.rows, self.pairs, self.size), np.ones(len(self.ids), bool)
        self.listed: np.ndarray | None = None

    def _list(self, table: np.ndarray) -> None:
        """Lists the best candidates by ``table``; what it leaves out has a bound of its own."""
        own = np.flatnonzero(self.left)
        values = value_at(table, self.cells[:, own])
        order = _best(values, self.ids[own], LISTED + 1)
        self.listed = own[order[:LISTED]]
        self.listed_cells = self.cells[:, self.listed]
        self.list_bound, self.list_table = float(values[order[LISTED]]) if len(order) > LISTED else -np.inf, table

    def best(self, table: np.ndarray) -> tuple[int, float]:
        """The place of the best candidate and its value; -1 if there is none."""
        for again in (False, True):
            if self.listed is None or again:
                self._list(table)
            if not len(self.listed):
                continue
            values = value_at(table, self.listed_cells)
            top = float(values.max())
            if self.list_table is table or top > self.list_bound + self.growth(table, self.list_table) + SLACK:
                own = self.listed[values == top]
                return int(own[self.ids[own].argmin()]), top
        return -1, -np.inf

    def stale(self, best: float, id_: int, by_id: bool, grown: float) -> np.ndarray:
        """Parts in which a better row than this may lie; at equal values one of a smaller id, or any if it may have grown."""
        bounds = self.bounds + grown
        above = bounds > best + SLACK
        equal = (bounds >= best - SLACK) & ((self.bound_ids < id_) | (not by_id))
        return np.flatnonzero((above | equal) & ~self.fresh & (bounds > -np.inf))

    def replace(self, parts: np.ndarray, found: pa.Table) -> int:
        """Takes what a job found in ``parts`` instead of what was known of them; returns the rows scored."""
        stay = self.left & ~np.isin(self.parts, parts)
        rest = np.asarray(found["rest"])
        new = found.filter(pa.array(~rest))
        self.ids = np.concatenate([self.ids[stay], np.asarray(new["id"])])
        self.rows = np.concatenate([self.rows[stay], np.asarray(pc.list_flatten(new["a"])).reshape(-1, self.width)])
        self.parts = np.concatenate([self.parts[stay], np.asarray(new["part"])])
        self.bounds[parts] = -np.inf
        others = found.filter(pa.array(rest)).select(["part", "value", "id", "n"]).to_pylist()
        for r in others:
            p = r["part"]
            self.bounds[p], self.bound_ids[p] = max((self.bounds[p], self.bound_ids[p]), (r["value"], r["id"]), key=lambda x: (x[0], -x[1]))
        self.fresh[parts] = True
        self._begin()
        return sum(r["n"] for r in others)

    def drop(self, at: int) -> None:
        self.left[at] = False
        other = self.listed != at
        self.listed, self.listed_cells = self.listed[other], self.listed_cells[:, other]


def _without(rows: DataFrame, ids: list[int]) -> DataFrame:
    gone = rows.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64())}))
    return rows.join(gone.hint("merge"), "id", "left_anti")


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """(id, a, part): rows written in parts by their ids."""
    return materialize(rows.repartition(parts, "id").select("id", "a", (F.spark_partition_id() % parts).alias("part")), "parts", by="part")


def in_parts(rows: DataFrame, table: np.ndarray, pairs: list[Pair], parts: int) -> DataFrame:
    """(id, a, part): rows written in parts by their value in ``table``, the largest first."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.asarray(b.column("a").flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("a"), pa.array(-value_of(sent.value, a, pairs))], ["id", "a", "low"])

    valued = materialize(rows.mapInArrow(run, "id long, a array<int>, low double"), "valued")
    ranged = valued.repartitionByRange(parts, "low", "id").select("id", "a", (F.spark_partition_id() % parts).alias("part"))
    return materialize(ranged, "parts", by="part")


def greedy(rows: DataFrame, pairs: list[Pair], steps: int, measure: str | Score = "mi", start: DataFrame | None = None, lazy: bool = False, keep: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(rank, id, score, scored): ``steps`` rows of (id, a), each the best to add to the ``start`` rows (id) and those before.

    Without ``start`` the row of the smallest id is it. ``score`` is the measure with the row added, ``scored`` the number of rows that jobs had to score for the step.
    """
    spark = rows.sparkSession
    score = MEASURES[measure] if isinstance(measure, str) else measure
    rows = rows.where(F.col("id").isNotNull() & F.col("a").isNotNull() & F.forall("a", lambda x: x.isNotNull())).select(F.col("id").cast("long").alias("id"), F.col("a").cast("array<int>").alias("a"))
    size = rows.agg(F.max(F.array_max("a")).alias("c"), F.min("id").alias("first"), F.max(F.size("a")).alias("w"), F.count("*").alias("n")).first()
    empty = spark.createDataFrame([], "rank long, id long, score double, scored long")
    if not size["n"]:
        return empty
    state = Grid(pairs, size["c"] + 1)
    if state.cells.size > LARGEST_TABLE:
        raise ValueError("the pairs' tables are too large for a driver")
    start = spark.createDataFrame([(size["first"],)], "id long") if start is None else start.select(F.col("id").cast("long").alias("id")).distinct()
    begun = rows.join(start, "id", "left_semi")
    counted = np.zeros(state.cells.shape)
    for r in agreement.contingency(begun, pairs).collect():  # cells of the table at most
        counted[r["pair"], r["i"], r["j"]] = r["n"]
    state.load(counted)
    now = 0.0  # the score so far, of which gains are counted; that of the start is the one with its last row added to the others
    if lazy and (last := begun.select("a").first()):
        state.put(np.array(last["a"]), -1)
        now = state.score_with(score, np.array(last["a"]))
        state.put(np.array(last["a"]))
    order = getattr(score, "order", None)
    make = (lambda: order(state)) if order and not lazy else (lambda: state.table(score))
    table = make()
    parts = max(1, min(PARTS, -(-size["n"] // part_rows)))
    keep = max(1, CANDIDATES // parts) if keep is None else keep
    others = rows.join(start, "id", "left_anti")
    written = in_parts(others, table, pairs, parts) if lazy else dealt(others, parts)
    pool = Pool(pairs, state.size, size["w"], np.full(parts, np.inf))
    since = table  # that of the last job
    chosen: list[tuple[int, int, float, int]] = []
    taken: dict[int, list[int]] = {p: [] for p in range(parts)}
    for rank in range(steps):
        scored = 0
        while True:
            at, best = pool.best(table)
            stale = pool.stale(best - (now if lazy else 0.0), int(pool.ids[at]) if at >= 0 else 0, lazy, 0.0 if lazy else pool.growth(table, since))
            if not len(stale):
                break
            if not lazy:
                stale, since = np.flatnonzero(pool.bounds > -np.inf), table
            wanted = written.where(F.col("part").isin(stale.tolist()))
            found = best_of_parts(wanted, table, pairs, keep, [i for p in stale.tolist() for i in taken[p]])
            scored += pool.replace(stale, found)
            if lazy:
                pool.bounds[stale] -= now
        if at < 0:
            break
        row, part = pool.rows[at], int(pool.parts[at])
        after = state.score_with(score, row)
        chosen.append((rank, int(pool.ids[at]), after, scored))
        taken[part].append(int(pool.ids[at]))
        pool.drop(at)
        state.put(row)
        table, now = make(), after
        pool.fresh[:] = False
    if not chosen:
        return empty
    columns = zip(("rank", "id", "score", "scored"), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), zip(*chosen, strict=True), strict=True)
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, kind, values in columns}))
