"""Running sums, rolling windows, tiles and grouping sets against plain loops, with series longer than a task's share."""

import itertools
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions.vectors import cosine
from viewloom.operators import agreement, clips, evaluation, retrieval, scan

RNG = np.random.default_rng(5)


def series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


ROWS = [(run, int(step), None if RNG.random() < 0.1 else float(RNG.integers(0, 9)), 7, "x") for run, n in (("long", 130), ("a", 3), (None, 20), ("b", 1)) for step in RNG.permutation(n)]
COLUMNS = "run string, step long, value double, at int, chunk string"


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_sums(spark, size):
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    out = scan.running(df, ["run"], ["step"], {"s": F.col("value"), "n": F.lit(1)}, size)
    assert out.columns == [*df.columns, "s", "n"]
    got = {(r["run"], r["step"]): (r["s"], r["n"], r["at"], r["chunk"]) for r in out.collect()}
    want = {(run, r[1]): (sum(x[2] or 0 for x in v[: i + 1]), i + 1, 7, "x") for run, v in series(ROWS).items() for i, r in enumerate(v)}
    assert got == want


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_rolling_statistics(spark, size):
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    out = evaluation.rolling(df, 5, size)
    assert out.columns == [*df.columns, "win_median", "win_avg", "global_avg"] and out.count() == len(ROWS)
    got = {(r["run"], r["step"]): (r["win_median"], r["win_avg"], r["global_avg"]) for r in out.collect()}
    known = lambda v: [x[2] for x in v if x[2] is not None]
    for run, v in series(ROWS).items():
        for i, r in enumerate(v):
            last, all_ = known(v[max(0, i - 4) : i + 1]), known(v[: i + 1])
            want = (statistics.median(last) if last else None, statistics.mean(last) if last else None, statistics.mean(all_) if all_ else None)
            assert got[run, r[1]] == (want if None in want else pytest.approx(want))


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_gains_and_prefixes_of_runs_cut_into_chunks(spark, size):
    runs = [(run, p, 10 * k + p, float(RNG.random())) for k, (run, n) in enumerate((("x", 30), ("y", 2), (None, 9))) for p in range(n)]
    df = spark.createDataFrame(runs, "run string, pos int, id int, score double")
    got = {(r["run"], r["pos"]): r["gain"] for r in retrieval.gain(df, size).collect()}
    score = {(r, p): s for r, p, _, s in runs}
    assert got == pytest.approx({(r, p): s + score.get((r, p - 1), 0.0) for (r, p), s in score.items()})
    truth = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "id int")
    for r in retrieval.prefix_metrics(df, truth, size).collect():
        ids = [i for run, p, i, _ in runs if run == r["run"] and p <= r["pos"]]
        hits = sum(i % 3 == 0 and i < 60 for i in ids)
        p, q = hits / len(ids), hits / 20
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((p, q, 2 * p * q / (p + q) if hits else 0.0))


def test_no_task_holds_a_series(spark):
    df = spark.range(5000).select(F.lit(0).alias("run"), F.col("id").alias("step"), F.rand(1).alias("value"))
    placed = scan.placed(df, ["run"], ["step"], None, 100)
    assert [r["count"] for r in placed.groupBy("chunk").count().collect()] == [100] * 50
    plan = scan.rolled(df, ["run"], ["step"], 10, {"m": lambda value, last: F.avg(value("value")).over(last)}, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "task#" in plan.split("Window")[1].split("\n")[0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert evaluation.rolling(df, 5).count() == 0
    assert retrieval.gain(spark.createDataFrame([], "run int, pos int, id int, score double")).count() == 0
    assert clips.similar_pairs(spark.createDataFrame([], "video int, clip int, vec array<double>"), cosine).count() == 0


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_tiled_pairs_equal_all_pairs(spark, tile):
    rows = [(v, c, [float(x) for x in RNG.normal(size=3)]) for v, n in (("one", 23), ("two", 2), ("single", 1), ("four", 4)) for c in range(n)]
    df = spark.createDataFrame(rows, "video string, clip int, vec array<double>").repartition(3)
    got = {(r["video"], r["a"], r["b"]): r["score"] for r in clips.similar_pairs(df, cosine, tile).collect()}
    want = {}
    for x, y in itertools.permutations(rows, 2):
        if x[0] == y[0] and x[1] < y[1]:
            a, b = np.array(x[2]), np.array(y[2])
            want[x[0], x[1], y[1]] = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tile", [2, 256])
def test_pairs_of_odd_vectors_and_equal_numbers(spark, tile, monkeypatch):
    monkeypatch.setattr(clips, "BATCH", 5)
    vecs = [[3.0, 4.0], [0.0, 0.0], None, [1.0, None], [4.0, 3.0, 0.0], [1.0, 0.0], [1.0, 0.0]]
    rows = [("v", c, x) for c, x in zip("abcdeff", vecs, strict=True)] + [("v", None, [1.0, 1.0]), (None, "a", [1.0, 1.0]), (None, "b", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "video string, clip string, vec array<double>").repartition(3)
    found = clips.similar_pairs(df, cosine, tile, places=6)
    got = [(r["a"], r["b"], r["score"]) for r in found.collect()]
    want = []
    for (_, a, x), (_, b, y) in itertools.product(rows[:7], rows[:7]):
        if a < b:
            whole = x and y and None not in x + y and len(x) == len(y)
            zero = whole and not (any(x) and any(y))
            want.append((a, b, "nan" if zero else round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6) if whole else None))
    assert sorted(((a, b, "nan" if s is not None and np.isnan(s) else s) for a, b, s in got), key=repr) == sorted(want, key=repr)
    plain = clips.similar_pairs(df.where("vec[0] > 0 or vec is null"), lambda a, b: cosine(a, b), tile, places=6)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted((tuple(r) for r in found.collect() if "b" not in (r["a"], r["b"])), key=repr)


def test_shuffled_bytes_grow_with_the_clips_and_not_with_their_pairs(spark):
    def shuffled(n):
        store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
        total = lambda: bus.waitUntilEmpty(30_000) or store.executorSummary("driver").totalShuffleWrite()
        df = spark.createDataFrame([("v", i, x.tolist()) for i, x in enumerate(np.random.default_rng(1).normal(size=(n, 32)))], "video string, clip int, vec array<double>")
        before = total()
        assert clips.similar_pairs(df, cosine, 8).count() == n * (n - 1) // 2
        return total() - before

    small, large = shuffled(250), shuffled(1000)
    assert 0 < large < 6 * small


def test_equal_scores_lie_side_by_side_in_each_pair_of_tiles(spark):
    rows = [("v", i, [float(RNG.integers(1, 4)), 1.0]) for i in range(60)]
    got = [r["score"] for r in clips.similar_pairs(spark.createDataFrame(rows, "video string, clip int, vec array<double>"), cosine, 64, places=6).collect()]
    assert len(got) == 60 * 59 // 2 and len(set(got)) > 3
    assert len(list(itertools.groupby(got))) == len(set(got))


def test_no_exchange_lowers_the_sum_of_a_local_search():
    best = []
    for trial in range(60):
        n, k = 4 + trial % 5, 1 + trial % 4
        s = RNG.random((n, n))
        s = s + s.T
        np.fill_diagonal(s, 0)
        got = clips._local_search(s, k, None)
        total = lambda c: s[np.ix_(list(c), list(c))].sum() / 2  # noqa: E731,B023
        assert len(set(got)) == k
        assert all(total((set(got) - {i}) | {j}) >= total(got) - 1e-9 for i in got for j in set(range(n)) - set(got))
        best.append(total(got) <= min(total(c) for c in itertools.combinations(range(n), k)) + 1e-9)
    assert sum(best) > 40
    assert clips._local_search(np.zeros((3, 3)), 9, None) == [0, 1, 2] and clips._local_search(np.zeros((3, 3)), 0, None) == []


def test_tallies_hold_cells_marginals_and_totals(spark):
    rows = RNG.integers(0, 3, (50, 3))
    cells = agreement.contingency(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, a array<int>"), [(0, 1), (1, 2)])
    got = {}
    for r in agreement.tallies(cells).collect():
        got.setdefault((r["pair"], r["kind"]), []).append(r["n"])
    for p, (x, y) in enumerate([(0, 1), (1, 2)]):
        t = np.zeros((3, 3), int)
        np.add.at(t, (rows[:, x], rows[:, y]), 1)
        want = {"cell": t[t > 0], "first": t.sum(1), "second": t.sum(0), "all": [50]}
        assert all(sorted(got[p, k]) == sorted(v) for k, v in want.items())
    plan = agreement.mutual_information(cells)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Expand" in plan and plan.count("Exchange hashpartitioning") <= 3
