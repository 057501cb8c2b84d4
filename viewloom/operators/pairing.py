"""Which clusterings are compared: pairs are data."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations, product
from statistics import median

from pyspark.sql import DataFrame, SparkSession

Pair = tuple[int, int]


def parts(name: str) -> tuple[str, str]:
    """View and layer of a clustering name, split at the first underscore."""
    view, _, layer = name.partition("_")
    return view, layer


def combination(names: list[str]) -> list[Pair]:
    return list(combinations(range(len(names)), 2))


def bipartite(names: list[str]) -> list[Pair]:
    """Every clustering of one view with every one of another."""
    return [(i, j) for i, j in combination(names) if parts(names[i])[0] != parts(names[j])[0]]


def diagonal(names: list[str]) -> list[Pair]:
    """Different views of the same layer."""
    return [(i, j) for i, j in bipartite(names) if parts(names[i])[1] == parts(names[j])[1]]


def layer(k: int) -> Callable[[list[str]], list[Pair]]:
    """Different views at the k-th layer name in sorted order."""

    def pick(names: list[str]) -> list[Pair]:
        layers = sorted({parts(n)[1] for n in names})
        return [(i, j) for i, j in diagonal(names) if layers.index(parts(names[i])[1]) == k]

    return pick


PAIRINGS: dict[str, Callable[[list[str]], list[Pair]]] = {"combination": combination, "bipartite": bipartite, "diagonal": diagonal, **{f"layer_{k}": layer(k) for k in range(5)}, "penultimate": layer(4)}


def as_table(spark: SparkSession, names: list[str], pairs: list[Pair]) -> DataFrame:
    return spark.createDataFrame([(p, names[i], names[j]) for p, (i, j) in enumerate(pairs)], "pair int, first string, second string")


def weights(depths: list[float], kind: str = "linear", coefficient: float = 1.0) -> list[float]:
    """Pair weights from depths: shifted so that the least is 2, shaped, divided by their median."""
    shifted = [d - min(depths) + 2 for d in depths]
    shape = {"linear": lambda x: coefficient * x, "log": lambda x: coefficient * math.log(x), "exp": lambda x: math.exp(coefficient * x)}
    if kind.startswith("onehot_"):
        return [float(i == int(kind.rpartition("_")[2])) for i in range(len(depths))]
    got = [shape[kind](x) for x in shifted]
    return [x / median(got) for x in got]


def grid(options: dict[str, list]) -> list[dict]:
    """All combinations of option values."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def without_overflow(options: list[dict], depths: int = 5, key: str = "weight_type") -> list[dict]:
    """Option sets whose pair weights stay finite when squared twice; ``key`` names the kind and, after a colon, its coefficient."""

    def fits(o: dict) -> bool:
        if o.get(key) is None:
            return True
        kind, _, coefficient = str(o[key]).partition(":")
        try:
            return all(math.isfinite(w**4) for w in weights([float(d) for d in range(depths)], kind, float(coefficient or 1)))
        except OverflowError:
            return False

    return [o for o in options if fits(o)]


def run_grid(options: list[dict], run: Callable[[dict], object], at_once: int = 4) -> list:
    """What ``run`` gives for each option set, in order; several Spark jobs are under way at once."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, options))
