"""Queries over clusterings: assignment, agreement, selection."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ..operators import agreement, clustering, pairing, selection, whole
from .base import ASSIGN_SQL, CELLS_SQL, CENTERS_SQL, FEATURES_SQL, NAMES, PAIRS, WIDTH, assignments, features, models, table, vectors, wide
from .registry import query

_MI = CELLS_SQL + ", mi as (select pair, sum(n / t * (ln(n) + ln(t) - ln(a) - ln(b))) mi from marg group by pair)"
_ENT = _MI + """, ha as (select pair, -sum(p * ln(p)) ha from (select pair, j, sum(n) / sum(sum(n)) over (partition by pair) p from cells group by pair, j) group by pair),
 hb as (select pair, -sum(p * ln(p)) hb from (select pair, i, sum(n) / sum(sum(n)) over (partition by pair) p from cells group by pair, i) group by pair)"""
_PC = CELLS_SQL + """, tp as (select pair, sum(n * (n - 1) / 2) tp, sum(n) * (sum(n) - 1) / 2 al from cells group by pair),
 pa as (select pair, sum(n * (n - 1) / 2) pa from (select pair, j, sum(n) n from cells group by all) group by pair),
 pb as (select pair, sum(n * (n - 1) / 2) pb from (select pair, i, sum(n) n from cells group by all) group by pair),
 pc as (select pair, tp, pa - tp fp, pb - tp fn, al - pa - pb + tp tn from tp join pa using (pair) join pb using (pair))"""


def cells(spark, d):
    return agreement.contingency(wide(spark, d), PAIRS)


@query("assign_nearest", f"with {ASSIGN_SQL} select id, clustering, k::int centroid, round(d, 6) distance from assigned")
def assign_nearest(spark, d):
    return assignments(spark, d).select("id", "clustering", "centroid", F.round("distance", 6).alias("distance"))


@query("assign_discount", f"""with {CENTERS_SQL}, cnt as (select label k, count(*) cnt from embeddings group by 1), tot as (select sum(cnt) t, count(*) kk from cnt),
  dist as (select f.id, f.clustering, c.k, sum((f.x - c.c) * (f.x - c.c)) / (case when any_value(cnt) < pow(any_value(t) / any_value(kk), 0.7) then 5 else 1 end) d from features f join centers c using (clustering, pos) join (select k, cnt * (k + 1) * (k + 1) // 20 cnt from cnt) q using (k), (select sum(cnt * (k + 1) * (k + 1) // 20) t, count(*) kk from cnt) group by 1, 2, 3)
  select id, clustering, k::int centroid from (select *, row_number() over (partition by id, clustering order by d, k) rn from dist) where rn = 1""")
def assign_discount(spark, d):
    rows = features(spark, d)
    counts = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # one row per label
    n = np.array([r["n"] * (r["label"] + 1) ** 2 // 20 for r in counts], float)
    found = {k: clustering.Model(m.centers, n) for k, m in models(rows).items()}
    return clustering.assign(rows.select("id", "clustering", "vec"), found, discount=True).select("id", "clustering", "centroid")


_WHOLE = """e as (select vec_id id, label, unnest(generate_series(0, 63)) pos, unnest(embedding)::double x from embeddings),
  c0 as (select label k, pos, avg(x) c from e group by all)"""


@query("sgd_step", f"""with {_WHOLE}, dist as (select id, k, sum((x - c) * (x - c)) d from e join c0 using (pos) group by all),
  near as (select id, k from (select *, row_number() over (partition by id order by d, k) rn from dist) where rn = 1),
  cnt as (select k, count(*) n from near group by k), mean as (select k, pos, avg(x) m from near join e using (id) group by all),
  lr as (select case when max(n) * 0.01 >= 1 then 0.5 / max(n) else 0.01 end lr from cnt)
  select k, pos::bigint pos, round(c * (1 - coalesce(n, 0) * lr) + lr * coalesce(n * m, 0), 6) x, 1 + coalesce(n, 0) n from c0 cross join lr left join cnt using (k) left join mean using (k, pos)""")
def sgd_step(spark, d):
    rows = vectors(spark, d)
    model = models(rows)["all"]
    sums, counts, _ = clustering.gather(rows, model, discount=False)
    new = clustering.step(model, sums, counts, 0.01)
    data = [(k, c.tolist(), int(n)) for k, (c, n) in enumerate(zip(new.centers, new.counts, strict=True))]
    out = spark.createDataFrame(data, "k int, center array<double>, n long")
    return out.select("k", F.posexplode("center").alias("pos", "x"), "n").select("k", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"), "n")


@query("whiten", f"""with {FEATURES_SQL}, s as (select clustering, pos, stddev_pop(x) s from features group by all)
  select id, clustering, pos, round(x / nullif(s, 0), 6) x from features join s using (clustering, pos)""")
def whiten(spark, d):
    out = clustering.whiten(features(spark, d), by="clustering")
    return out.select("id", "clustering", F.posexplode("vec").alias("pos", "x")).select("id", "clustering", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("mean_distance", f"with {ASSIGN_SQL} select clustering, round(avg(d), 6) mean_distance from assigned group by 1")
def mean_distance(spark, d):
    return assignments(spark, d).groupBy("clustering").agg(F.round(F.avg("distance"), 6).alias("mean_distance"))


def _pairing(name, where):
    order = f"with {FEATURES_SQL}, names as (select distinct clustering c, split_part(clustering, '_', 1) v, split_part(clustering, '_', 2) l from features)"
    sql = f"{order} select row_number() over (order by x.c, y.c) - 1 pair, x.c \"first\", y.c \"second\" from names x join names y on x.c < y.c where {where}"

    def run(spark, d):
        return pairing.as_table(spark, NAMES, pairing.PAIRINGS[name](NAMES))

    query(f"pairs_{name}", sql)(run)


_pairing("combination", "true")
_pairing("bipartite", "x.v <> y.v")
_pairing("diagonal", "x.v <> y.v and x.l = y.l")
_pairing("layer_1", "x.v <> y.v and x.l = y.l and x.l = 'layer1'")


@query("pair_weights", """with d as (select r_regionkey p, (r_regionkey * 3 % 7)::double depth from region), s as (select p, depth - min(depth) over () + 2 x from d),
  w as (select p, 0.5 * x lin, ln(x) lg from s) select p pair, round(lin / median(lin) over (), 6) linear, round(lg / median(lg) over (), 6) log from w""")
def pair_weights(spark, d):
    depths = [float(r * 3 % 7) for r in range(5)]
    rows = zip(range(5), pairing.weights(depths, "linear", 0.5), pairing.weights(depths, "log"), strict=True)
    return spark.createDataFrame(list(rows), "pair int, linear double, log double").select("pair", F.round("linear", 6).alias("linear"), F.round("log", 6).alias("log"))


@query("contingency", f"with {CELLS_SQL} select pair, i, j, n, a, b, t total from marg")
def contingency(spark, d):
    return agreement.with_marginals(cells(spark, d))


@query("contingency_orders", """with p as (select 0 pair, ascii(l_returnflag) i, ascii(l_linestatus) j, count(*) n from lineitem group by all union all select 1, ascii(l_returnflag), l_linenumber, count(*) from lineitem group by all),
  m as (select *, sum(n) over (partition by pair, j) a, sum(n) over (partition by pair, i) b, sum(n) over (partition by pair) t from p) select pair, round(sum(n / t * (ln(n) + ln(t) - ln(a) - ln(b))), 6) mi from m group by pair""")
def contingency_orders(spark, d):
    li = table(spark, d, "lineitem").select(F.array(F.ascii("l_returnflag"), F.ascii("l_linestatus"), F.col("l_linenumber")).alias("a"))
    return agreement.mutual_information(agreement.contingency(li, [(0, 1), (0, 2)])).select("pair", F.round("mi", 6).alias("mi"))


@query("co_assigned", f"with {ASSIGN_SQL}, c as (select clustering, k, count(*) n from assigned group by all) select clustering, sum(n * (n - 1) / 2) pairs from c group by 1")
def co_assigned(spark, d):
    return agreement.co_assigned(assignments(spark, d))


@query("mi", f"with {_MI} select pair, round(mi, 6) mi from mi")
def mi(spark, d):
    return agreement.mutual_information(cells(spark, d)).select("pair", F.round("mi", 6).alias("mi"))


@query("mi_sql", f"with {_MI} select pair, round(mi, 6) mi from mi")
def mi_sql(spark, d):
    """The same from SQL text alone: pairs by an unfolded list, cells by one aggregation, MI by the registered aggregate."""
    from ..functions import sql

    sql.register(spark)
    rows = wide(spark, d)
    pairs = ", ".join(f"named_struct('pair', {p}, 'i', a[{x}], 'j', a[{y}])" for p, (x, y) in enumerate(PAIRS))
    text = f"""with cells as (select c.pair, c.i, c.j, count(*) n from (select explode(array({pairs})) c from {{rows}}) group by all)
      select pair, round(mi_of_cells(i, j, n), 6) mi from cells group by pair"""
    return spark.sql(text, rows=rows)


_ADDED = f"""with {CELLS_SQL}, sel as (@selected), held as (select pair, x.k i, y.k j, count(*) n from pairs join assigned x on x.clustering = c1 join assigned y on y.clustering = c2 and y.id = x.id where x.id in (select id from sel) group by all),
  ha as (select pair, j, sum(n) a from held group by all), hb as (select pair, i, sum(n) b from held group by all), f as (select 0 v),
  tot as (select pair, sum(n)::double n, sum(n * ln(n)) nn from held group by pair), ta as (select pair, sum(a * ln(a)) aa from ha group by pair), tb as (select pair, sum(b * ln(b)) bb from hb group by pair),
  cand as (select x.id, pair, x.k i, y.k j from pairs join assigned x on x.clustering = c1 join assigned y on y.clustering = c2 and y.id = x.id where @candidates),
  st as (select id, pair, tot.n + 1 n, nn, aa, bb, coalesce(held.n, 0) c, coalesce(a, 0) a, coalesce(b, 0) b from cand join tot using (pair) join ta using (pair) join tb using (pair) left join held using (pair, i, j) left join ha using (pair, j) left join hb using (pair, i)),
  added as (select id, pair, (nn + (c + 1) * ln(c + 1) - c * ln(greatest(c, 1)) - aa - (a + 1) * ln(a + 1) + a * ln(greatest(a, 1)) - bb - (b + 1) * ln(b + 1) + b * ln(greatest(b, 1))) / n + ln(n) mi from st)"""


@query("mi_incremental", _ADDED.replace("@selected", "select distinct id from assigned").replace("@candidates", "true") + " select id, pair, round(mi, 6) mi from added")
def mi_incremental(spark, d):
    """Every row as if it were added once more to the counts of all rows."""
    rows = wide(spark, d)
    have = agreement.contingency(rows, PAIRS)
    return agreement.mi_after_adding(agreement.sums(have), have, rows, PAIRS).select("id", "pair", F.round("mi", 6).alias("mi"))


@query("entropy", f"with {_ENT} select pair, round(ha, 6) ha, round(hb, 6) hb from ha join hb using (pair)")
def entropy(spark, d):
    return agreement.entropies(cells(spark, d)).select("pair", F.round("ha", 6).alias("ha"), F.round("hb", 6).alias("hb"))


@query("nmi_doubled", f"with {_ENT} select pair, round(2 * mi / ((ha + hb) / 2), 6) nmi, round(mi / greatest(ha, hb), 6) nmi_max from mi join ha using (pair) join hb using (pair)")
def nmi_doubled(spark, d):
    c = cells(spark, d)
    both = agreement.doubled_nmi(c).join(agreement.normalized_mi(c, "max").withColumnRenamed("nmi", "nmi_max"), "pair")
    return both.select("pair", F.round("nmi", 6).alias("nmi"), F.round("nmi_max", 6).alias("nmi_max"))


@query("emi_ami", f"""with {_ENT}, emi as (select pair, sum(n / t * (ln(n) + ln(t) - ln(a) - ln(b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) emi from marg group by pair)
  select pair, round((mi - emi) / greatest((ha + hb) / 2 - emi, 2.220446049250313e-16), 6) ami from mi join emi using (pair) join ha using (pair) join hb using (pair)""")
def emi_ami(spark, d):
    return agreement.adjusted_mi(cells(spark, d)).select("pair", F.round("ami", 6).alias("ami"))


_EMI = _ENT + """, ma as (select pair, j, sum(n) a from cells group by all), mb as (select pair, i, sum(n) b from cells group by all), mt as (select pair, sum(n) t from cells group by pair),
  em as (select pair, a, b, t, unnest(generate_series(greatest(1, a + b - t)::bigint, least(a, b)::bigint)) n from ma join mb using (pair) join mt using (pair)),
  emi as (select pair, sum(n / t * (ln(n) + ln(t) - ln(a) - ln(b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) emi from em group by pair)"""


@query("expected_mi", f"with {_EMI} select pair, round(emi, 6) emi from emi")
def expected_mi(spark, d):
    return agreement.expected_mi(cells(spark, d)).select("pair", F.round("emi", 6).alias("emi"))


@query("usual_ami", f"with {_EMI} select pair, round((mi - emi) / greatest((ha + hb) / 2 - emi, 2.220446049250313e-16), 6) ami from mi join emi using (pair) join ha using (pair) join hb using (pair)")
def usual_ami(spark, d):
    return agreement.usual_ami(cells(spark, d)).select("pair", F.round("ami", 6).alias("ami"))


@query("fowlkes_mallows", f"with {_PC} select pair, round(sqrt(tp / (tp + fp) * tp / (tp + fn)), 6) fm from pc")
def fowlkes_mallows(spark, d):
    return agreement.fowlkes_mallows(cells(spark, d)).select("pair", F.round("fm", 6).alias("fm"))


@query("rand_index", f"with {_PC} select pair, round((tp + tn) / (tp + fp + fn + tn), 6) rand from pc")
def rand_index(spark, d):
    return agreement.rand(cells(spark, d)).select("pair", F.round("rand", 6).alias("rand"))


@query("adjusted_rand", f"with {_PC} select pair, round(2 * (tp * tn - fn * fp) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0), 6) ari from pc")
def adjusted_rand(spark, d):
    return agreement.adjusted_rand(cells(spark, d)).select("pair", F.round("ari", 6).alias("ari"))


@query("pair_agreement", f"with {_PC} select pair, round((tp / (tp + fp) + tp / (tp + fn)) / 2, 6) ratio from pc")
def pair_agreement(spark, d):
    return agreement.pair_agreement(cells(spark, d)).select("pair", F.round("ratio", 6).alias("ratio"))


@query("weighted_mean_score", f"with {_MI} select round(avg(mi * (1 + pair % 3)), 6) score from mi")
def weighted_mean_score(spark, d):
    s = agreement.mutual_information(cells(spark, d))
    return agreement.mean_score(s, "mi", {p: 1 + p % 3 for p in range(len(PAIRS))}).select(F.round("score", 6).alias("score"))


@query("constant_measure", f"with {CELLS_SQL} select distinct pair, 1.0::double constant from cells")
def constant_measure(spark, d):
    return agreement.constant(cells(spark, d))


_PROFILE = ASSIGN_SQL + """, lab as (select k centroid, label, count(*) n from assigned join embeddings on vec_id = id where clustering = 'a_layer1' group by all),
  dense as (select c.centroid, l.label, coalesce(n, 0) n from (select distinct centroid from lab) c cross join (select distinct label from embeddings) l left join lab using (centroid, label)),
  prof as (select centroid, label, n, n / (sum(n) over (partition by centroid) + 1e-10) share from dense)"""


def _profile(spark, d):
    a = assignments(spark, d).where("clustering = 'a_layer1'").select("id", "centroid")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return agreement.class_profile(a.join(labels, "id"))


@query("class_cluster_profile", f"with {_PROFILE} select centroid::int centroid, label, n, round(share, 6) share from prof")
def class_cluster_profile(spark, d):
    return _profile(spark, d).withColumn("share", F.round("share", 6))


@query("mean_surprise", f"with {_PROFILE} select round(avg(-p * ln(p + 1e-20)), 6) mean_surprise from (select n / sum(n) over () p from prof)")
def mean_surprise(spark, d):
    return agreement.mean_surprise(_profile(spark, d)).select(F.round("mean_surprise", 6).alias("mean_surprise"))


@query("closest_cluster", f"""with {_PROFILE}, dd as (select x.centroid a, y.centroid b, avg(pow(x.share - y.share, 2)) d from prof x join prof y using (label) where x.centroid <> y.centroid group by all)
  select a::int centroid, b::int closest from (select *, row_number() over (partition by a order by round(d, 9), b) rn from dd) where rn = 1""")
def closest_cluster(spark, d):
    return agreement.closest_cluster(_profile(spark, d))


_STEP = _ADDED.replace("@selected", "select min(vec_id) id from embeddings group by label").replace("@candidates", "x.id not in (select id from sel)") + " select id, round(avg(mi), 6) score from added group by id"


@query("greedy_step_scores", _STEP)
def greedy_step_scores(spark, d):
    """The first step after a start of one row per class: the scores of all other rows."""
    rows, start = wide(spark, d), _start(spark, d)
    return selection.step_scores(rows.join(start, "id", "left_semi"), rows.join(start, "id", "left_anti"), PAIRS).withColumn("score", F.round("score", 6))


@query("batch_step_topk", f"select id, score from (select *, row_number() over (order by score desc, id) rn from ({_STEP})) where rn <= 4")
def batch_step_topk(spark, d):
    from ..operators.ordering import top

    return top(greedy_step_scores(spark, d), "score", 4)


def _greedy_sql(steps):
    """The first steps of a greedy selection over the whole table, each scored from the counts of the rows before it."""
    block = _ADDED.partition("sel as (@selected), ")[2].replace("@candidates", "x.id not in (select id from sel)")
    names = ("sel", "held", "ha", "hb", "f", "tot", "ta", "tb", "cand", "st", "added")
    sql = f"with {CELLS_SQL}, sel0 as (select min(vec_id) id from embeddings group by label)"
    for s in range(steps):
        own = block
        for n in names:
            own = re.sub(rf"\b{n}\b", f"{n}{s}", own)
        sql += f", {own}, best{s} as (select id, avg(mi) score from added{s} group by id order by round(score, 9) desc, id limit 1), sel{s + 1} as (select id from sel{s} union all select id from best{s})"
    return sql + " " + " union all ".join(f'select {s}::bigint "rank", id, round(score, 6) score from best{s}' for s in range(steps))


def _start(spark, d):
    from ..operators.retrieval import start_per_class

    return start_per_class(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")).select("id")  # one per class


@query("greedy_whole_steps", _greedy_sql(3))
def greedy_whole_steps(spark, d):
    """The first three steps over all rows, after a start of one row per class."""
    return whole.greedy(wide(spark, d), PAIRS, 3, start=_start(spark, d)).select("rank", "id", F.round("score", 6).alias("score"))


@query("greedy_whole_table")
def greedy_whole_table(spark, d):
    """A fifth of all rows, each the best to add to those before."""
    rows = wide(spark, d)
    return whole.greedy(rows, PAIRS, round(0.2 * rows.count()), start=_start(spark, d)).drop("scored")


@query("lazy_whole_table")
def lazy_whole_table(spark, d):
    """As many rows as it takes to see most combinations of centroids, by stale gains; ``scored`` counts the rows scored again."""
    rows = wide(spark, d)
    return whole.greedy(rows, PAIRS, round(0.05 * rows.count()), "covered", _start(spark, d), lazy=True)


def _chunks(spark, d):
    return selection.chunked(wide(spark, d), 500)


@query("greedy_select_batch")
def greedy_select_batch(spark, d):
    return selection.select(_chunks(spark, d), PAIRS, 0.2, measure="mi", strategy="batch")


@query("greedy_select_full")
def greedy_select_full(spark, d):
    return selection.select(_chunks(spark, d), PAIRS, 0.2, measure="mi", strategy="greedy", start="cluster")


@query("greedy_select_lazy")
def greedy_select_lazy(spark, d):
    return selection.select(_chunks(spark, d), PAIRS, 0.2, measure="nmi", strategy="lazy")


@query("greedy_select_pair_measure")
def greedy_select_pair_measure(spark, d):
    return selection.select(_chunks(spark, d), PAIRS, 0.1, measure="fm", strategy="greedy")


@query("greedy_select_ami")
def greedy_select_ami(spark, d):
    return selection.select(selection.chunked(wide(spark, d), 100), PAIRS[:6], 0.1, measure="ami", strategy="batch")


@query("greedy_select_hybrid")
def greedy_select_hybrid(spark, d):
    return selection.select(_chunks(spark, d), PAIRS, 0.1, measure="mi", strategy="hybrid", start="cluster")


@query("sharded_retrieval")
def sharded_retrieval(spark, d):
    from ..operators.retrieval import sharded_selection, shards_for

    rows = wide(spark, d)
    return sharded_selection(rows, PAIRS, 0.2, shards_for(rows.count(), 1000))


@query("shard_offsets", "select vec_id id, least((row_number() over (order by vec_id) - 1) // 125, 3) shard, row_number() over (order by vec_id) - 1 - least((row_number() over (order by vec_id) - 1) // 125, 3) * 125 \"local\" from embeddings")
def shard_offsets(spark, d):
    from ..operators.retrieval import sharded

    return sharded(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), 4, 125)


@query("kmeans_library")
def kmeans_library(spark, d):
    rows = vectors(spark, d).select("id", "clustering", "vec")
    return clustering.assign(rows, clustering.cluster_all(rows, [8], "library"))


@query("kmeans_train")
def kmeans_train(spark, d):
    rows = vectors(spark, d).select("id", "clustering", "vec")
    return clustering.assign(rows, {"all": clustering.train(rows, 8)}, discount=True)


@query("kmeans_multi_k")
def kmeans_multi_k(spark, d):
    rows = vectors(spark, d).select("id", "vec")
    found = {f"k{k}": clustering.train(rows, k, epochs=1) for k in (4, 8)}
    each = rows.select("id", "vec", F.explode(F.array(*map(F.lit, found))).alias("clustering"))
    return clustering.assign(each, found).groupBy("clustering", "centroid").agg(F.count("*").alias("n"))


@query("principal_similarity")
def principal_similarity(spark, d):
    from ..functions.vectors import affine
    from ..operators.retrieval import by_similarity
    from .base import views

    rows = views(spark, d)
    out = {}
    for v in ("va", "vb"):
        mean, axes = clustering.principal(rows, WIDTH, v)
        out[v] = affine(F.col(v), axes.tolist(), (-(axes @ mean)).tolist())
    return by_similarity(rows.select("id", *[c.alias(v) for v, c in out.items()]), "cs", 100)
