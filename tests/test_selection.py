"""Selections, clusterings and samples against versions that score every choice from its definition."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import agreement, clips, clustering, evaluation, pairing, retrieval, selection

RNG = np.random.default_rng(11)
ROWS = RNG.integers(0, 3, (40, 4))
PAIRS = pairing.combination(["a_0", "a_1", "b_0", "b_1"])[:3]


def table(x, y):
    out = np.zeros((4, 4), int)
    np.add.at(out, (x, y), 1)
    return out


def mutual(t):
    n = t.sum()
    return sum(t[i, j] / n * math.log(t[i, j] * n / t[i].sum() / t[:, j].sum()) for i, j in zip(*np.nonzero(t), strict=True))


def entropy(m):
    return -sum(x / m.sum() * math.log(x / m.sum()) for x in m if x)


def expected(a, b):
    """The mean over tables with these marginals, from exact binomials."""
    n, out = int(a.sum()), 0.0
    for x, y in itertools.product(a, b):
        x, y = int(x), int(y)
        for k in range(max(1, x + y - n), min(x, y) + 1):
            out += k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
    return out


def adjusted(t):
    e = expected(t.sum(1), t.sum(0))
    return (mutual(t) - e) / max((entropy(t.sum(1)) + entropy(t.sum(0))) / 2 - e, np.finfo(float).eps)


def together(t):
    two = lambda x: (x * (x - 1) / 2).sum()
    return two(t), two(t.sum(1)), two(t.sum(0)), t.sum() * (t.sum() - 1) / 2


def fowlkes(t):
    tp, a, b, _ = together(t)
    return tp / math.sqrt(a * b) if a and b else 0.0


def rand(t):
    tp, a, b, n = together(t)
    return (n - a - b + 2 * tp) / n


DEFINED = {"mi": mutual, "ami": adjusted, "fm": fowlkes, "rand": rand}


def score(rows, chosen, name):
    return float(np.mean([DEFINED[name](table(rows[chosen, i], rows[chosen, j])) for i, j in PAIRS]))


def best(rows, chosen, left, name):
    """The candidate of the largest score; of equal ones the smallest."""
    s = [round(score(rows, [*chosen, c], name), 9) for c in left]
    return left[int(np.argmax(s))], max(s)


@pytest.mark.parametrize("name", sorted(DEFINED))
def test_greedy_takes_the_best_row_at_each_step(name):
    got = selection.greedy(ROWS, PAIRS, 14, selection.MEASURES[name], [0, 5, 9])
    for step in range(3, 14):
        chosen = [r for r, _ in got[:step]]
        left = [r for r in range(len(ROWS)) if r not in chosen]
        assert got[step][1] == pytest.approx(best(ROWS, chosen, left, name)[1], abs=1e-8)
        assert score(ROWS, [*chosen, got[step][0]], name) == pytest.approx(got[step][1], abs=1e-8)


@pytest.mark.parametrize("name", sorted(DEFINED))
def test_batch_takes_the_best_of_each_batch(name):
    got = selection.batch(ROWS, PAIRS, 12, selection.MEASURES[name], [0], width=8, take=2)
    chosen, queue = [0], list(range(1, len(ROWS)))
    while len(chosen) < 12:
        now, queue = queue[:8], queue[8:]
        s = {c: round(score(ROWS, [*chosen, c], name), 9) for c in now}
        take = got[len(chosen) : len(chosen) + 2]
        assert sorted((round(s[r], 7) for r, _ in take), reverse=True) == sorted((round(x, 7) for x in s.values()), reverse=True)[: len(take)]
        chosen += [r for r, _ in take]
        queue += [c for c in now if c not in chosen]
    assert [r for r, _ in got] == chosen


def test_lazy_and_hybrid_scores_are_those_of_their_rows():
    for f in (selection.lazy, selection.hybrid):
        got = f(ROWS, PAIRS, 15, selection.MEASURES["mi"], [0, 5, 9])
        assert len({r for r, _ in got}) == 15
        for step in range(4, 15):  # the first lazy step's scores are fresh; later ones are refreshed at the top
            assert got[step][1] == pytest.approx(score(ROWS, [r for r, _ in got[: step + 1]], "mi"), abs=1e-8)
    plain = selection.greedy(ROWS, PAIRS, 9, selection.MEASURES["mi"], [0, 5, 9])
    assert selection.hybrid(ROWS, PAIRS, 15, selection.MEASURES["mi"], [0, 5, 9])[:9] == plain


def test_a_measure_may_be_a_function(spark):
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(ROWS)], "id long, chunk int, a array<int>")
    by_name = selection.select(df, PAIRS, 0.2, measure="rand").collect()
    assert selection.select(df, PAIRS, 0.2, measure=selection.rand).collect() == by_name


def test_usual_ami_equals_its_definition(spark):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(ROWS)], "id long, a array<int>")
    cells = agreement.contingency(df, PAIRS)
    got = {r["pair"]: r["ami"] for r in agreement.usual_ami(cells).collect()}
    assert [got[p] for p in range(3)] == pytest.approx([adjusted(table(ROWS[:, i], ROWS[:, j])) for i, j in PAIRS], abs=1e-9)


def test_ami_of_large_counts_sums_few_terms(spark):
    """Counts of a hundred million: independent views have an AMI of 0."""
    n = 25_000_000
    cells = spark.createDataFrame([(0, i, j, n) for i in range(2) for j in range(2)], "pair int, i int, j int, n long")
    assert abs(agreement.usual_ami(cells).first()["ami"]) < 1e-6


def test_step_scores_equal_their_definition(spark):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(ROWS)], "id long, a array<int>")
    got = {r["id"]: r["score"] for r in selection.step_scores(df.where("id < 6"), df.where("id >= 6"), PAIRS).collect()}
    assert got == pytest.approx({c: score(ROWS, [*range(6), c], "mi") for c in range(6, 40)})


def test_shards_are_selected_alone_and_placed_in_the_whole(spark):
    df = spark.createDataFrame([(100 + i, r.tolist()) for i, r in enumerate(ROWS)], "id long, a array<int>")
    got = retrieval.sharded_selection(df, PAIRS, 0.3, 3, 13, buckets=3, strategy="greedy").collect()
    for shard, (lo, hi) in enumerate([(0, 13), (13, 26), (26, 40)]):
        mine = [r for r in got if r["shard"] == shard]
        assert len(mine) == round((hi - lo) * 0.3) and all(lo <= r["place"] < hi for r in mine)
        chosen = [r["place"] for r in sorted(mine, key=lambda r: r["rank"])]
        for step in range(1, len(chosen)):
            left = [r for r in range(lo, hi) if r not in chosen[:step]]
            assert score(ROWS, chosen[: step + 1], "mi") == pytest.approx(best(ROWS, chosen[:step], left, "mi")[1])


def test_chunks_keep_their_size_as_the_table_grows(spark):
    for n in (90, 900):
        sizes = selection.chunked(spark.range(n).withColumn("a", F.array(F.lit(1))), 40, buckets=3).groupBy("chunk").count().collect()
        assert sorted(r["count"] for r in sizes)[1:] == [40] * (n // 40) and sum(r["count"] for r in sizes) == n


def test_batch_losses_equal_their_definition(spark):
    from viewloom.operators import contrastive

    x, y = RNG.normal(size=(50, 4)), RNG.normal(size=(50, 4))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, va array<double>, vb array<double>")
    dealt = contrastive.batched(df, 20, buckets=2)
    ids = {}
    for r in dealt.collect():
        ids.setdefault(r["batch"], []).append(r["id"])
    got = {r["batch"]: (r["n"], r["loss"]) for r in contrastive.batch_losses(dealt).collect()}
    assert sorted(map(len, ids.values())) == [10, 20, 20]
    for b, mine in ids.items():
        s = np.array([[x[i] @ y[j] / np.linalg.norm(x[i]) / np.linalg.norm(y[j]) / contrastive.TEMPERATURE for j in mine] for i in mine])
        loss = np.mean([np.log(np.exp(s[k]).sum()) + np.log(np.exp(s[:, k]).sum()) for k in range(len(mine))]) / 2 - np.mean(np.diag(s))
        assert got[b] == (len(mine), pytest.approx(loss))


def _trained_by_hand(x, k, epochs, batch, initial_rounds, group_rows, parallel, seed=0):
    """Batches in the order of md5(seed-id); groups of a round go on from one model and are averaged by the rows each gave a centre."""
    import hashlib

    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest())
    centers, counts = np.random.default_rng(seed).random((k, x.shape[1])) * 1e-5, np.zeros(k)
    groups = [order[i : i + group_rows] for i in range(0, len(x), group_rows)]
    for epoch in range(epochs):
        for first in range(0, len(groups), parallel):
            ends = []
            for g in range(first, min(first + parallel, len(groups))):
                c, n, rng = centers.copy(), counts.copy(), np.random.default_rng([seed, epoch, g])
                for lo in range(0, len(groups[g]), batch):
                    part = x[groups[g][lo : lo + batch]]
                    if n.sum() < initial_rounds * k:
                        at = rng.random((len(part), k)).argmin(1)
                    else:
                        few = n < (n.sum() / k) ** 0.7
                        at = (((part[:, None] - c[None]) ** 2).sum(2) / np.where(few, 5.0, 1.0)).argmin(1)
                    own = np.bincount(at, minlength=k)
                    rate = 0.1 ** (2 + epoch // 5)
                    rate = 0.5 / own.max() if own.max() * rate >= 1 else rate
                    for j in range(k):
                        c[j] = c[j] * (1 - own[j] * rate) + rate * part[at == j].sum(0)
                    n += own
                ends.append((c, n - counts))
            total = sum(n for _, n in ends)
            for j in range(k):
                if total[j]:
                    centers[j] = sum(n[j] * c[j] for c, n in ends) / total[j]
            counts = counts + total
    return centers, counts


@pytest.mark.parametrize(("batch", "rounds_", "group_rows", "parallel"), [(32, 2, 65_536, 64), (8, 1, 30, 2), (300, 0, 300, 1)])
def test_training_equals_its_steps_done_by_hand(spark, batch, rounds_, group_rows, parallel):
    x = RNG.normal(size=(240, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = clustering.train(df, 4, batch=batch, initial_rounds=rounds_, group_rows=group_rows, parallel=parallel)
    centers, counts = _trained_by_hand(x, 4, 2, batch, rounds_, group_rows, parallel)
    assert np.allclose(got.centers, centers) and np.allclose(got.counts, counts) and counts.sum() == 480
    again = clustering.train(df.repartition(7), 4, batch=batch, initial_rounds=rounds_, group_rows=group_rows, parallel=parallel)
    assert (again.centers == got.centers).all() and (again.counts == got.counts).all()


def test_contrastive_steps_grow_with_rows_and_repeat_exactly(spark):
    from viewloom.operators import contrastive

    base = RNG.normal(size=(600, 3))
    x, y = base @ RNG.normal(size=(3, 5)), base @ RNG.normal(size=(3, 4))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, va array<double>, vb array<double>")
    state = {}
    for n, options in ((600, {}), (150, {}), (600, {"group_rows": 100, "parallel": 3})):
        part = df.where(F.col("id") < n)
        p, losses = contrastive.train(part, m=4, epochs=3, size=50, rate=0.02, **options)
        q, again = contrastive.train(part.repartition(5), m=4, epochs=3, size=50, rate=0.02, **options)
        assert losses == again and all((a == b).all() for a, b in zip(p.parts(), q.parts(), strict=True))
        state[n, bool(options)] = losses
    assert len(state[600, False]) == 3 and len(state[600, True]) == 6
    assert state[600, False][-1] < state[150, False][-1] < state[150, False][0] and state[600, True][-1] < state[600, True][0]


def test_library_clusters_find_separate_groups(spark):
    x = np.concatenate([RNG.normal(m, 0.1, (30, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, c, v.tolist()) for i, v in enumerate(x) for c in ("p", "q")], "id long, clustering string, vec array<double>")
    found = clustering.cluster_all(df, [2, 3], "library")
    assert sorted(found) == ["p_2", "p_3", "q_2", "q_3"] and sorted(found["p_3"].counts) == [30, 30, 30]
    assert np.allclose(sorted(found["q_3"].centers[:, 0]), [0, 5, 10], atol=0.2)


SIM = np.array([[0, 0.9, 0.2, 0.4, 0.7], [0.9, 0, 0.8, 0.1, 0.6], [0.2, 0.8, 0, 0.5, 0.3], [0.4, 0.1, 0.5, 0, 0.9], [0.7, 0.6, 0.3, 0.9, 0]])


def test_diversity_strategies(spark):
    rows = [("v", i, j, float(SIM[i, j])) for i in range(5) for j in range(i + 1, 5)] + [("w", 0, 1, 0.5)]
    df = spark.createDataFrame(rows, "video string, a int, b int, score double")
    total = lambda c: sum(SIM[i, j] for i, j in itertools.combinations(c, 2))
    for name in clips.DIVERSITY:
        got = clips.picked(df, 3, name).orderBy("video", "rank").collect()
        v = [r["clip"] for r in got if r["video"] == "v"]
        assert len(set(v)) == 3 and [r["rank"] for r in got if r["video"] == "v"] == [0, 1, 2] and len(got) == 5
        if name == "min_pair":
            assert v == [0, 2, 4]
        if name == "greedy":
            assert all(SIM[v[:k], v[k]].sum() == min(SIM[v[:k], c].sum() for c in range(5) if c not in v[:k]) for k in (1, 2))
        if name == "sum_pairs":  # no swap lowers the sum by the factor
            assert all(total([*(set(v) - {i}), j]) >= total(v) - (SIM[i, [x for x in v if x != i]].sum()) * (1 - 1 / 1.02) - 1e-9 for i in v for j in range(5) if j not in v)
        if name == "random1_then":
            assert v[1:] == sorted((c for c in range(5) if c != v[0]), key=lambda c: SIM[v[0], c])[:2]


def test_compared_runs_and_ratios(spark):
    runs = spark.createDataFrame([("x", 0, 1, 1.0), ("x", 1, 2, 2.0), ("y", 0, 1, 3.0), ("y", 1, 5, 2.5)], "run string, pos int, id int, gain double")
    assert tuple(evaluation.compared_runs(runs).first()) == ("x", "y", 0.5, 1.25)
    batches = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "batch int, id int")
    truth = spark.createDataFrame([(2,), (2,)], "id int")
    assert {r["batch"]: r["ratio"] for r in evaluation.positives_ratio(batches, truth).collect()} == {0: 0.5, 1: 0.0}
