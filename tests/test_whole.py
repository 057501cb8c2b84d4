"""Selection over a whole table against versions that score every candidate at every step."""

import numpy as np
import pytest

from viewloom.operators import pairing, selection, whole

RNG = np.random.default_rng(17)
PAIRS = pairing.combination(["a_0", "a_1", "b_0", "b_1"])


def table(spark, rows, ids=None):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(range(len(rows)) if ids is None else ids, rows, strict=True)], "id long, a array<int>").repartition(5)


def by_hand(rows, start, steps, score):
    """Every candidate's score at every step, from counts of its own; ties to the smallest row."""
    out, chosen = [], list(start)
    for _ in range(min(steps, len(rows) - len(start))):
        left = np.setdiff1d(np.arange(len(rows)), chosen)
        state = selection.Counts(rows, PAIRS)
        state.add(np.array(chosen, int))
        s = score(state, left)
        at = int(np.argmax(np.round(s, 9)))
        out.append((int(left[at]), float(s[at])))
        chosen.append(int(left[at]))
    return out


def same(got, want):
    assert [r["rank"] for r in got] == list(range(len(want))) and [r["id"] for r in got] == [i for i, _ in want]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in want], abs=1e-9)


@pytest.mark.parametrize(("measure", "steps", "keep", "part_rows"), [("mi", 60, 16, 100), ("mi", 25, 2, 41), ("nmi", 8, 8, 130), ("fm", 8, 8, 500), ("rand", 6, 8, 130), ("arand", 6, 4, 130), ("constant", 5, 2, 200)])
def test_exact_steps_equal_brute_force(spark, measure, steps, keep, part_rows):
    rows = RNG.integers(0, 4, (500, 4))
    rows[:, 2] = np.where(RNG.random(500) < 0.6, rows[:, 0], rows[:, 2])
    got = whole.greedy(table(spark, rows), PAIRS, steps, measure, keep=keep, part_rows=part_rows).orderBy("rank").collect()
    same(got, by_hand(rows, [0], steps, selection.MEASURES[measure]))
    assert got[0]["scored"] >= 499
    if measure == "mi" and keep == 16:  # most steps are taken without a job
        assert sum(r["scored"] == 0 for r in got) > 30


def test_exact_steps_of_a_measure_given_as_a_function(spark):
    rows = RNG.integers(0, 3, (120, 4))

    def balance(state, ids):
        c, a, b = state.around(ids)
        return -(c + a + b).max(axis=1)

    one = [PAIRS[0]]
    got = whole.greedy(table(spark, rows), one, 12, balance, keep=3, part_rows=50).orderBy("rank").collect()
    chosen = [0]
    for r in got:
        left = np.setdiff1d(np.arange(120), chosen)
        state = selection.Counts(rows, one)
        state.add(np.array(chosen))
        assert r["id"] == left[int(np.argmax(balance(state, left)))]
        chosen.append(r["id"])


def test_lazy_equals_exact_where_gains_shrink(spark):
    rows = RNG.integers(0, 9, (500, 4))
    df = table(spark, rows)
    want = by_hand(rows, [0], 40, selection.MEASURES["covered"])
    lazy = whole.greedy(df, PAIRS, 40, "covered", lazy=True, keep=8, part_rows=60).orderBy("rank").collect()
    exact = whole.greedy(df, PAIRS, 40, "covered", keep=8, part_rows=60).orderBy("rank").collect()
    same(lazy, want)
    same(exact, want)
    again = sum(r["scored"] for r in lazy) - lazy[0]["scored"]
    assert again < 40 * 460 / 4 and any(0 < r["scored"] < 460 for r in lazy)


def test_starts_nulls_and_the_end_of_the_table(spark):
    rows = RNG.integers(0, 3, (12, 4))
    extra = spark.createDataFrame([(None, [0, 0, 0, 0]), (900, None), (901, [0, None, 0, 0])], "id long, a array<int>")
    df = table(spark, rows, range(100, 112)).union(extra).selectExpr("*", "1 as part", "2 as value")
    start = spark.createDataFrame([(103,), (103,), (105,), (7,)], "id long")
    got = whole.greedy(df, PAIRS, 50, start=start, keep=2, part_rows=5).orderBy("rank").collect()
    same([{**r.asDict(), "id": r["id"] - 100} for r in got], by_hand(rows, [3, 5], 50, selection.information))
    assert len(got) == 10
    assert whole.greedy(df.limit(0), PAIRS, 3).count() == 0 and whole.greedy(df, PAIRS, 0).count() == 0
    nowhere = whole.greedy(df, PAIRS, 2, start=start.where("id = 7")).orderBy("rank").collect()
    assert [r["id"] for r in nowhere] == [100 + i for i, _ in by_hand(rows, [], 2, selection.information)]


def test_equal_rows_go_in_the_order_of_their_ids(spark):
    rows = np.zeros((90, 4), int)
    got = whole.greedy(table(spark, rows), PAIRS, 30, keep=4, part_rows=20).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(1, 31))


def test_few_steps_need_a_job(spark):
    rng = np.random.default_rng(5)
    true = rng.integers(0, 6, 1500)
    rows = np.where(rng.random((1500, 4)) < 0.5, true[:, None], rng.integers(0, 6, (1500, 4)))
    got = whole.greedy(table(spark, rows), PAIRS, 100, keep=100, part_rows=500).orderBy("rank").collect()
    same(got, by_hand(rows, [0], 100, selection.MEASURES["mi"]))
    assert sum(r["scored"] > 0 for r in got) < 12  # about 20 where bounds grow step by step


def test_no_value_grows_by_more_than_the_bound():
    grown = RNG.normal(size=(len(PAIRS), 3, 3))
    rows = np.array(np.unravel_index(np.arange(3**4), (3,) * 4)).T
    bound, most = whole.Growth(PAIRS)(grown, np.zeros_like(grown)), whole.value_of(grown, rows, PAIRS).max()
    assert most <= bound + 1e-8 and bound <= grown.max(axis=(1, 2)).sum() + 1e-8


def test_candidates_off_the_short_list_come_back(spark, monkeypatch):
    monkeypatch.setattr(whole, "LISTED", 3)
    rows = RNG.integers(0, 4, (200, 4))
    for lazy, measure in ((False, "mi"), (True, "covered")):
        got = whole.greedy(table(spark, rows), PAIRS, 30, measure, lazy=lazy, keep=40, part_rows=100).orderBy("rank").collect()
        same(got, by_hand(rows, [0], 30, selection.MEASURES[measure]))
