"""Clips from shot boundaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered_by


def shots(boundaries: DataFrame) -> DataFrame:
    """Consecutive boundaries (video, t) as intervals, the first from 0; what follows the last is no shot."""
    begin = F.lag("t", 1, 0.0).over(W.partitionBy("video").orderBy("t"))
    return boundaries.select("video", begin.alias("start"), F.col("t").alias("end"))


def valid(shots_: DataFrame, least: float, crop: bool = False) -> DataFrame:
    """Intervals of at least ``least`` seconds; with ``crop`` exactly that long, from the middle."""
    out = shots_.where(F.col("end") - F.col("start") >= least)
    if not crop:
        return out
    middle = (F.col("start") + F.col("end")) / 2
    return out.withColumns({"start": middle - least / 2, "end": middle + least / 2})


def with_fallback(clips: DataFrame, videos: DataFrame, length: float) -> DataFrame:
    """One centred clip for each video (video, duration) without any; its start may be negative."""
    none = videos.join(clips.select("video").distinct(), "video", "left_anti")
    middle = F.col("duration") / 2
    return clips.select("video", "start", "end").unionByName(none.select("video", (middle - length / 2).alias("start"), (middle + length / 2).alias("end")))


def relaxed_count(duration, thresholds: list[float], clips: int):
    """Clips wanted of a video: halved for each duration threshold from the second that it stays under, 1 at least."""
    passed = sum((F.when(duration < t, 1).otherwise(0) for t in thresholds[1:]), F.lit(0))
    return F.greatest(F.lit(1), F.ceil(F.lit(clips) / F.pow(F.lit(2), passed)))


def annealed(scored: DataFrame, wanted: int, least: float, start: float = 10.0, factor: float = 1.2, top: float = 100.0) -> DataFrame:
    """Per video the first threshold at which enough clips are long enough, or the last one.

    ``scored`` has (video, t, score). Boundaries below the threshold fall away, so shots get longer as it
    rises. All levels are tried at once as rows, in one shuffle by video and level.
    """
    levels, t = [], start
    while t < top:
        levels.append(t)
        t *= factor
    each = scored.select("video", "t", "score", F.posexplode(F.array(*map(F.lit, levels))).alias("level", "threshold")).where("score >= threshold")
    begin = F.lag("t", 1, 0.0).over(W.partitionBy("video", "level").orderBy("t"))
    counted = each.withColumn("start", begin).groupBy("video", "level", "threshold").agg(F.sum(F.when(F.col("t") - F.col("start") >= least, 1).otherwise(0)).alias("n"))
    enough = F.when(F.col("n") >= wanted, F.col("level")).otherwise(F.lit(len(levels)) + F.lit(len(levels)) - F.col("level"))
    best = F.min_by(F.struct("threshold", "n"), enough)
    return counted.groupBy("video").agg(best.alias("b")).select("video", F.col("b.threshold").alias("threshold"), F.col("b.n").alias("n"))


#: Clips of a video that are compared with as many others at once; pairs of a batch that a task hands on; pairs of a task, tasks at most.
TILE, BATCH, TASK_PAIRS, TASKS = 2048, 1 << 16, 1 << 22, 10_000

#: Tiles of a video that are copied to meet each other.
COPIES = 8


def similar_pairs(clips: DataFrame, score, tile: int = TILE, places: int | None = None) -> DataFrame:
    """All pairs of clips (video, clip, vec) of one video, the smaller first, with ``score(a, b)`` of their vectors, rounded to ``places`` if given.

    A video's clips are dealt to tiles in order, and any task can compare any pair of tiles, so a video that holds
    all clips is spread like any other. Clips with equal numbers make no pair.
    A score with a form ``of_tiles`` is computed for a pair of tiles at once, another one for each pair of clips. A vector that is null or
    has a null makes null scores, as do two of different lengths.
    """
    n = numbered_by(clips.select("video", "clip", "vec"), ["video"], ["clip"], "_at", "_n")
    both = _pairs_of_tiles(n.select("video", "clip", "vec", F.floor(F.col("_at") / tile).cast("int").alias("tile"), F.ceil(F.col("_n") / tile).cast("int").alias("tiles")))
    if hasattr(score, "of_tiles"):
        return _scores_of_tiles(both, score.of_tiles, places)
    each = both.select("video", F.explode("ca").alias("x"), "cb").select("video", "x", F.explode("cb").alias("y")).where("x.clip < y.clip")
    found = score(F.col("x.vec"), F.col("y.vec"))
    return each.select("video", F.col("x.clip").alias("a"), F.col("y.clip").alias("b"), (found if places is None else F.round(found, places)).alias("score"))


def _pairs_of_tiles(n: DataFrame) -> DataFrame:
    """Pairs of tiles (video, ca, cb) of a video, each one with itself and those after it, as arrays of (clip, vec).

    Few bytes make many pairs, so the number of pairs decides on the number of tasks. A video's tiles, if they are at most COPIES, are
    copied once for each other and joined by keys. Those of longer videos are dealt to parts, written once, and a task reads two
    parts: what is written grows with the clips and not with the pairs.
    """
    tiles = n.where("video is not null and clip is not null").groupBy("video", "tile").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("clip", "vec")).alias("c"))
    long = F.col("tiles") > COPIES
    videos = n.groupBy("video").agg(F.count("*").cast("double").alias("n"), F.first("tiles").alias("tiles"))
    pairs = {r["long"]: r["pairs"] for r in videos.groupBy(long.alias("long")).agg(F.sum(F.col("n") * F.col("n") / 2).alias("pairs")).collect()}
    found = []
    if True in pairs:
        parts = tiles.where(long).select("video", "tile", "c").repartition(max(1, min(math.isqrt(TASKS), math.ceil(math.sqrt(pairs[True] / TASK_PAIRS)))))
        a, b = (parts.select(F.col("video").alias(f"v{x}"), F.col("tile").alias(f"t{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
        found.append(a.join(b.hint("shuffle_replicate_nl"), F.expr("va = vb and ta <= tb")).select(F.col("va").alias("video"), "ca", "cb"))
    if False in pairs or not pairs:
        short, tasks = tiles.where(~long), max(1, min(TASKS, int(pairs.get(False, 0) / TASK_PAIRS) + 1))
        a = short.select("video", F.col("c").alias("ca"), F.col("tile").alias("ta"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tb"))
        b = short.select("video", F.col("c").alias("cb"), F.col("tile").alias("tb"), F.explode(F.sequence(F.lit(0), "tile")).alias("ta"))
        a, b = (x.repartition(tasks, "video", "ta", "tb") for x in (a, b))
        found.append(a.join(b, ["video", "ta", "tb"]).select("video", "ca", "cb"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _rows_of(vecs):
    """An Arrow list array as a matrix padded with zeros, and each row's length, -1 where it is null or holds a null."""
    import numpy as np
    import pyarrow.compute as pc

    flat, sizes = vecs.flatten(), np.asarray(pc.fill_null(pc.list_value_length(vecs), 0))
    width = int(sizes.max(initial=0))
    lengths = np.where(np.asarray(vecs.is_null(), bool), -1, sizes)
    inside = np.arange(width) < sizes[:, None]
    x = np.zeros((len(vecs), width))
    x[inside] = np.asarray(pc.fill_null(flat.cast("float64", safe=False), 0.0))
    if flat.null_count:
        lost = np.zeros(x.shape, bool)
        lost[inside] = np.asarray(flat.is_null(), bool)
        lengths[lost.any(axis=1)] = -1
    return x, lengths


def _scores_of_tiles(both: DataFrame, of_tiles, places: int | None) -> DataFrame:
    """A matrix product for each pair of tiles, handed on by some rows at a time.

    Its rows are in the order of their scores: files that hold equal scores side by side are smaller.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    video, clip = (both.schema[0].dataType.simpleString(), both.schema[1].dataType.elementType["clip"].dataType.simpleString())
    both = both.select("video", "ca.clip", "ca.vec", F.col("cb.clip").alias("clip_b"), F.col("cb.vec").alias("vec_b"))

    def blocks(video, clip_a, vec_a, clip_b, vec_b):
        """Columns of the pairs of two tiles."""
        (x, la), (y, lb) = _rows_of(vec_a), _rows_of(vec_b)
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
        rank = np.asarray(pc.rank(pa.concat_arrays([clip_a, clip_b]), tiebreaker="dense")).astype(np.int64)
        ra, rb = rank[: len(x)], rank[len(x) :]
        scores, right = of_tiles(x, y), ra[:, None] < rb
        scores = (scores if places is None else np.round(scores, places)).ravel()
        lost = (la[:, None] != lb) | (la[:, None] < 0)
        mask = lost.ravel() if lost.any() else None
        low = (1 << scores.size.bit_length()) - 1
        key = scores.view(np.int64) & ~low  # the last bits of a score give way to its place
        key |= np.arange(key.size)
        key.sort()
        key &= low
        own = key if right.all() else key[right.ravel()[key]]
        for at in range(0, own.size, BATCH):
            some = own[at : at + BATCH]
            i, j = np.divmod(some, len(y))
            yield [pa.repeat(video, len(i)), clip_a.take(pa.array(i)), clip_b.take(pa.array(j)), pa.array(scores[some], pa.float64(), mask=None if mask is None else mask[some])]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                video, *lists = (c[r] for c in batch.columns)
                for columns in blocks(video, *(v.values for v in lists)):
                    held.append(pa.RecordBatch.from_arrays(columns, ["video", "a", "b", "score"]))
                    size += held[-1].num_rows
                    if size >= BATCH:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, size = [], 0
        if size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return both.mapInArrow(run, f"video {video} not null, a {clip} not null, b {clip} not null, score double")


def diverse(pairs: DataFrame, k: int) -> DataFrame:
    """Greedy diversity per video: least similar pairs first, their clips until k are chosen."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list = []
        for r in pdf.sort_values(["score", "a", "b"]).itertuples():
            chosen += [c for c in (r.a, r.b) if c not in chosen]
            if len(chosen) >= k:
                break
        return pd.DataFrame({"video": pdf["video"].iloc[0], "clip": chosen[:k], "rank": range(len(chosen[:k]))})

    clip = dict(pairs.dtypes)["a"]
    return pairs.groupBy("video").applyInPandas(run, f"video {dict(pairs.dtypes)['video']}, clip {clip}, rank long")


def _matrix(pdf):
    """Clips in order and their symmetric similarities."""
    import numpy as np

    clips = sorted({*pdf["a"], *pdf["b"]})
    at = {c: i for i, c in enumerate(clips)}
    sim = np.zeros((len(clips), len(clips)))
    for a, b, s in zip(pdf["a"], pdf["b"], pdf["score"], strict=True):
        sim[at[a], at[b]] = sim[at[b], at[a]] = s
    return clips, sim


def _nearest_unused(sim, k: int, rng) -> list[int]:
    """From the first clip on, each time the least similar to the last one that is not chosen yet."""
    import numpy as np

    chosen = [0]
    while len(chosen) < min(k, len(sim)):
        rest = np.setdiff1d(np.arange(len(sim)), chosen)
        chosen.append(int(rest[sim[chosen[-1], rest].argmin()]))
    return chosen


def _greedy_sum(sim, k: int, rng) -> list[int]:
    """From a random clip on, each time the one least similar in sum to those chosen."""
    import numpy as np

    order = rng.permutation(len(sim))
    chosen = [int(order[0])]
    while len(chosen) < min(k, len(sim)):
        rest = order[~np.isin(order, chosen)]
        chosen.append(int(rest[sim[chosen][:, rest].sum(axis=0).argmin()]))
    return chosen


def _local_search(sim, k: int, rng, rounds: int = 1000) -> list[int]:
    """A set of k clips whose summed similarity no exchange of one member for another clip lowers.

    With x the 0/1 vector of the set, the sum is x S x / 2, and exchanging i for j changes it by (S x)_j - (S x)_i - S_ij.
    All exchanges of a round are one matrix, of which the steepest is made; the sum falls each round, so rounds end.
    """
    import numpy as np

    x = np.zeros(len(sim), bool)
    x[np.argsort(sim.sum(axis=0), kind="stable")[:k]] = True
    for _ in range(rounds):
        pull = sim[:, x].sum(axis=1)
        inside, outside = np.flatnonzero(x), np.flatnonzero(~x)
        change = pull[outside][None, :] - pull[inside][:, None] - sim[np.ix_(inside, outside)]
        if not change.size or change.min() > -1e-9:
            break
        i, j = divmod(int(change.argmin()), len(outside))
        x[inside[i]], x[outside[j]] = False, True
    return np.flatnonzero(x).tolist()


def _random(sim, k: int, rng) -> list[int]:
    return [int(x) for x in rng.permutation(len(sim))[:k]]


def _random_then(sim, k: int, rng, n_random: int) -> list[int]:
    """Random clips, then those that are least similar to them in sum."""
    order = rng.permutation(len(sim))
    first, rest = order[:n_random], order[n_random:]
    return [int(x) for x in [*first, *rest[sim[first][:, rest].sum(axis=0).argsort(kind="stable")[: max(k - n_random, 0)]]]]


#: Ways to pick k diverse clips of a video from its similarities.
DIVERSITY = {
    "greedy": _greedy_sum, "min_pair": _nearest_unused, "sum_pairs": _local_search, "random": _random,
    "random_then": lambda sim, k, rng: _random_then(sim, k, rng, -(-k // 2)), "random1_then": lambda sim, k, rng: _random_then(sim, k, rng, 1),
}


def picked(pairs: DataFrame, k: int, strategy: str = "greedy", seed: int = 0) -> DataFrame:
    """(video, clip, rank) of k clips per video by one of DIVERSITY; a video's clips are few and one task's group."""
    import zlib

    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, sim = _matrix(pdf)
        video = pdf["video"].iloc[0]
        got = DIVERSITY[strategy](sim, k, np.random.default_rng([seed, zlib.crc32(str(video).encode())]))[:k]
        return pd.DataFrame({"video": video, "clip": [names[i] for i in got], "rank": range(len(got))})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("video").applyInPandas(run, f"video {kinds['video']}, clip {kinds['a']}, rank long")
