"""How strongly clusterings agree: contingency tables and measures over them.

Assignments come as rows (id, clustering, centroid) or as one array per id. All pairs of clusterings are
counted by one explode and one aggregation with map-side combine; everything after has
pairs x centroids x centroids rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import lgamma, n_log_n, pairs_of
from .pairing import Pair

EPS = 2.220446049250313e-16


def wide(assignments: DataFrame, names: list[str]) -> DataFrame:
    """(id, a) with the centroids in the order of ``names``; ids that lack a clustering are dropped."""
    at = F.map_from_entries(F.collect_list(F.struct("clustering", "centroid")))
    got = assignments.groupBy("id").agg(at.alias("_m"))
    return got.select("id", F.array(*[F.element_at("_m", F.lit(n)) for n in names]).alias("a")).where(F.forall("a", lambda x: x.isNotNull()))


def contingency(rows: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(pair, i, j, n) of the non-empty cells."""
    each = F.array(*[F.struct(F.lit(p).alias("pair"), F.get("a", F.lit(x)).alias("i"), F.get("a", F.lit(y)).alias("j")) for p, (x, y) in enumerate(pairs)])
    return rows.select(F.explode(each).alias("c")).groupBy("c.pair", "c.i", "c.j").agg(F.count("*").alias("n"))


def with_marginals(cells: DataFrame) -> DataFrame:
    """Adds a (total of j), b (total of i) and the pair's total; rows are dealt by pair once for all three."""
    return cells.repartition("pair").withColumns({
        "a": F.sum("n").over(W.partitionBy("pair", "j")), "b": F.sum("n").over(W.partitionBy("pair", "i")), "total": F.sum("n").over(W.partitionBy("pair")),
    })


def tallies(cells: DataFrame) -> DataFrame:
    """(pair, kind, n): the counts of cells, of both marginals and of the pair as a whole, from one aggregation by grouping sets.

    ``kind`` is ``cell``, ``first`` (a total of i), ``second`` (a total of j) or ``all``.
    """
    sets = [[F.col(c) for c in x] for x in (("pair", "i", "j"), ("pair", "i"), ("pair", "j"), ("pair",))]
    each = cells.groupingSets(sets, "pair", "i", "j").agg(F.sum("n").alias("n"), F.grouping("i").alias("gi"), F.grouping("j").alias("gj"))
    kind = F.when(F.col("gi") + F.col("gj") == 0, "cell").when(F.col("gi") == 0, "first").when(F.col("gj") == 0, "second").otherwise("all")
    return each.select("pair", kind.alias("kind"), "n")


def moments(cells: DataFrame) -> DataFrame:
    """One row per pair with what all measures are made of: ``n``, the sums of x ln x (``nn`` of cells, ``bb`` of the first
    marginal, ``aa`` of the second), and the pairs of rows together (``tp`` in both, ``pb`` in the first, ``pa`` in the second)."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    log, two = n_log_n(F.col("n")), pairs_of(F.col("n"))
    return tallies(cells).groupBy("pair").agg(
        of("all", F.col("n")).alias("n"), of("cell", log).alias("nn"), of("second", log).alias("aa"), of("first", log).alias("bb"),
        of("cell", two).alias("tp"), of("second", two).alias("pa"), of("first", two).alias("pb"),
    )


def mutual_information(cells: DataFrame) -> DataFrame:
    """(pair, mi) over non-empty cells, in double."""
    return moments(cells).select("pair", mi_from_sums(*map(F.col, ("nn", "aa", "bb", "n"))).alias("mi"))


def sums(cells: DataFrame) -> DataFrame:
    """(pair, nn, aa, bb, n): the sums of x ln x over cells and both marginals, the state of the incremental form."""
    return moments(cells).select("pair", "nn", "aa", "bb", "n")


def mi_from_sums(nn: Column, aa: Column, bb: Column, n: Column) -> Column:
    return (nn - aa - bb) / n + F.ln(n)


def mi_after_adding(state: DataFrame, cells: DataFrame, candidates: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(id, pair, mi) if a candidate row were added to the counted ones, from its three counts alone."""
    each = F.array(*[F.struct(F.lit(p).alias("pair"), F.get("a", F.lit(x)).alias("i"), F.get("a", F.lit(y)).alias("j")) for p, (x, y) in enumerate(pairs)])
    c = candidates.select("id", F.explode(each).alias("c")).select("id", "c.*")
    a = cells.groupBy("pair", "j").agg(F.sum("n").alias("ca"))
    b = cells.groupBy("pair", "i").agg(F.sum("n").alias("cb"))
    joined = c.join(F.broadcast(state), "pair").join(cells.withColumnRenamed("n", "cn"), ["pair", "i", "j"], "left").join(a, ["pair", "j"], "left").join(b, ["pair", "i"], "left")

    def grown(total: str, count: str) -> Column:
        x = F.coalesce(F.col(count), F.lit(0))
        return F.col(total) - n_log_n(x) + n_log_n(x + 1)

    return joined.select("id", "pair", mi_from_sums(grown("nn", "cn"), grown("aa", "ca"), grown("bb", "cb"), F.col("n") + 1).alias("mi"))


def co_assigned(assignments: DataFrame) -> DataFrame:
    """(clustering, pairs): pairs of rows in one cluster, from the cluster sizes."""
    n = assignments.groupBy("clustering", "centroid").agg(F.count("*").alias("n"))
    return n.groupBy("clustering").agg(F.sum(pairs_of(F.col("n"))).alias("pairs"))


def informations(cells: DataFrame) -> DataFrame:
    """(pair, mi, ha, hb): MI and the entropies of both marginals, of the second's totals and of the first's."""
    n = F.col("n")
    return moments(cells).select("pair", mi_from_sums(*map(F.col, ("nn", "aa", "bb", "n"))).alias("mi"), (F.ln(n) - F.col("aa") / n).alias("ha"), (F.ln(n) - F.col("bb") / n).alias("hb"))


def entropies(cells: DataFrame) -> DataFrame:
    """(pair, ha, hb): entropies of both marginals."""
    return informations(cells).drop("mi")


MEANS = {"arithmetic": lambda x, y: (x + y) / 2, "max": F.greatest, "min": F.least}


def doubled_nmi(cells: DataFrame, mean: str = "arithmetic") -> DataFrame:
    """2 MI over the mean entropy: with the arithmetic mean twice the usual normalised value."""
    return informations(cells).select("pair", (2 * F.col("mi") / F.greatest(MEANS[mean](F.col("ha"), F.col("hb")), F.lit(EPS))).alias("nmi"))


def normalized_mi(cells: DataFrame, mean: str = "arithmetic") -> DataFrame:
    """The usual MI over the mean entropy."""
    return doubled_nmi(cells, mean).select("pair", (F.col("nmi") / 2).alias("nmi"))


def cell_expected_mi(cells: DataFrame) -> DataFrame:
    """(pair, emi) with each cell's probability under fixed marginals at its own count only."""
    m = with_marginals(cells)
    g = lambda x: lgamma(x.cast("double") + 1.0)
    n, a, b, t = (F.col(c) for c in ("n", "a", "b", "total"))
    log_p = g(a) + g(b) + g(t - a) + g(t - b) - g(t) - g(n) - g(a - n) - g(b - n) - g(t - a - b + n)
    term = n / t * (F.ln(n) + F.ln(t) - F.ln(a) - F.ln(b)) * F.exp(log_p)
    return m.groupBy("pair").agg(F.sum(term).alias("emi"))


def adjusted_mi(cells: DataFrame, mean: str = "arithmetic") -> DataFrame:
    """(MI - EMI) / max(mean entropy - EMI, eps), EMI as in ``cell_expected_mi``."""
    j = informations(cells).join(cell_expected_mi(cells), "pair")
    below = F.greatest(MEANS[mean](F.col("ha"), F.col("hb")) - F.col("emi"), F.lit(EPS))
    return j.select("pair", ((F.col("mi") - F.col("emi")) / below).alias("ami"))


#: Standard deviations around its mean within which a count is summed: beyond, less than exp(-2 * WIDE) of it is left.
WIDE = 18.0


def expected_mi(cells: DataFrame) -> DataFrame:
    """(pair, emi): the mean MI of random tables with the same marginals.

    Each cell's count is hypergeometric. Of its possible values those within WIDE deviations of the mean are
    rows, so their number grows with the root of the counts and not with the counts.
    """
    total = cells.groupBy("pair").agg(F.sum("n").alias("t"))
    a, b = (cells.groupBy("pair", x).agg(F.sum("n").alias(y)).select("pair", y) for x, y in (("j", "a"), ("i", "b")))
    m = a.join(b, "pair").join(F.broadcast(total), "pair").select("pair", *[F.col(c).cast("double").alias(c) for c in "abt"])
    mean = F.col("a") * F.col("b") / F.col("t")
    spread = F.sqrt(mean * (F.col("t") - F.col("a")) * (F.col("t") - F.col("b")) / F.col("t") / F.greatest(F.col("t") - 1, F.lit(1.0))) * WIDE + WIDE
    low = F.greatest(F.lit(1.0), F.col("a") + F.col("b") - F.col("t"), F.floor(mean - spread))
    high = F.least("a", "b", F.ceil(mean + spread))
    g = lambda x: lgamma(x + 1.0)
    a, b, t, n = (F.col(c) for c in ("a", "b", "t", "n"))
    m = m.withColumn("fixed", g(a) + g(b) + g(t - a) + g(t - b) - g(t))
    m = m.select("*", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")
    m = m.select("pair", "a", "b", "t", "fixed", F.explode(F.sequence("low", "high")).alias("n")).withColumn("n", F.col("n").cast("double"))
    log_p = F.col("fixed") - g(n) - g(a - n) - g(b - n) - g(t - a - b + n)
    emi = m.groupBy("pair").agg(F.sum(n / t * (F.ln(n) + F.ln(t) - F.ln(a) - F.ln(b)) * F.exp(log_p)).alias("emi"))
    return total.join(emi, "pair", "left").select("pair", F.coalesce("emi", F.lit(0.0)).alias("emi"))


def usual_ami(cells: DataFrame, mean: str = "arithmetic") -> DataFrame:
    """(MI - EMI) / (mean entropy - EMI) with the mean over all tables; the divisor keeps its sign and eps as least size."""
    j = informations(cells).join(expected_mi(cells), "pair")
    below = MEANS[mean](F.col("ha"), F.col("hb")) - F.col("emi")
    below = F.when(below < 0, F.least(below, F.lit(-EPS))).otherwise(F.greatest(below, F.lit(EPS)))
    return j.select("pair", ((F.col("mi") - F.col("emi")) / below).alias("ami"))


def pair_counts(cells: DataFrame) -> DataFrame:
    """(pair, tp, fp, fn, tn): pairs of rows together in both, in the second, in the first, in neither."""
    tp, pa, pb = (F.col(c) for c in ("tp", "pa", "pb"))
    return moments(cells).select("pair", "tp", (pa - tp).alias("fp"), (pb - tp).alias("fn"), (pairs_of(F.col("n")) - pa - pb + tp).alias("tn"))


def fowlkes_mallows(cells: DataFrame) -> DataFrame:
    c = pair_counts(cells)
    return c.select("pair", F.sqrt(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).alias("fm"))


def rand(cells: DataFrame) -> DataFrame:
    c = pair_counts(cells)
    return c.select("pair", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("rand"))


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """2 (tp tn - fn fp) / ((tp + fn)(fn + tn) + (tp + fp)(fp + tn)); null where that is 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return pair_counts(cells).select("pair", F.try_divide(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)).alias("ari"))


def pair_agreement(cells: DataFrame) -> DataFrame:
    """(pair, ratio): the mean over both clusterings of pairs agreed by both over pairs agreed by one."""
    c = pair_counts(cells)
    return c.select("pair", ((F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")) + F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))) / 2).alias("ratio"))


def constant(cells: DataFrame) -> DataFrame:
    return cells.select("pair").distinct().withColumn("constant", F.lit(1.0))


#: Measures by name, each from cells to (pair, value).
MEASURES = {
    "mi": mutual_information, "ami": usual_ami, "cell_ami": adjusted_mi, "nmi": normalized_mi, "doubled_nmi": doubled_nmi, "fm": fowlkes_mallows,
    "rand": rand, "arand": adjusted_rand, "agreement": pair_agreement, "constant": constant,
}


def mean_score(scores: DataFrame, value: str, weights: dict[int, float] | None = None) -> DataFrame:
    """The mean over pairs; weights multiply the scores and are not divided out."""
    w = F.lit(1.0)
    if weights:
        w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("pair"))
    return scores.agg(F.avg(F.col(value) * w).alias("score"))


def class_profile(rows: DataFrame, label: str = "label", cluster: str = "centroid") -> DataFrame:
    """(cluster, label, n, share): how each cluster's rows fall on classes, on the dense grid."""
    n = rows.groupBy(cluster, label).agg(F.count("*").alias("n"))
    dense = rows.select(cluster).distinct().join(rows.select(label).distinct(), how="cross").join(n, [cluster, label], "left")
    dense = dense.select(cluster, label, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(W.partitionBy(cluster))
    return dense.withColumn("share", F.col("n") / (total + F.lit(1e-10)))


def mean_surprise(profile: DataFrame) -> DataFrame:
    """The mean, not the sum, of -p ln(p + 1e-20) over the grid normalised as a whole."""
    total = profile.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return profile.crossJoin(F.broadcast(total)).agg(F.avg(-p * F.ln(p + F.lit(1e-20))).alias("mean_surprise"))


def closest_cluster(profile: DataFrame, label: str = "label", cluster: str = "centroid") -> DataFrame:
    """Each cluster's nearest other one by mean squared difference of class shares; the grid is small."""
    a, b = (profile.select(F.col(cluster).alias(x), label, F.col("share").alias(f"{x}_share")) for x in ("a", "b"))
    d = a.join(b, label).where("a != b").groupBy("a", "b").agg(F.avg(F.pow(F.col("a_share") - F.col("b_share"), F.lit(2))).alias("d"))
    return d.groupBy("a").agg(F.min_by("b", F.struct(F.round("d", 9), "b")).alias("closest")).withColumnRenamed("a", cluster)
